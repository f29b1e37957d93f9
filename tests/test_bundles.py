"""Archives land many to a file, and come out as they went in."""

import io
import zipfile

from pagegrist.plans import q_rules, registry
from pagegrist.sources import registries


def test_archives_land_many_to_a_file(spark, sf, monkeypatch):
    folders, write = [], q_rules.sinks.write_files
    monkeypatch.setattr(q_rules.sinks, "write_files", lambda s, files, folder: folders.append((write(s, files, folder), files)))
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert registry.queries()["archive_members"](spark, sf).count() == docs
    assert 0 < folders[0][0] < docs / 4


def test_an_archive_of_too_many_members_is_whole():
    raw = q_rules._archive(5, "é text")
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert len(z.namelist()) == 1001 and z.read("sites.js").decode() == "é text" and z.read("m999") == b"" and z.testzip() is None
    assert registries.zip_member(raw, "sites.js") is None
    assert registries.zip_member(q_rules._archive(7, "é text"), "sites.js") == "é text"
