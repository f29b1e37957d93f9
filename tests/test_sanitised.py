"""Rule texts without their token lines, and archives as files, against plain Python."""

import io
import random
import re
import zipfile

from pyspark.sql import functions as F

from pagegrist.sources import registries, rules, sinks


def scanned(line: str) -> bool:
    """Plain Python: a line that is one cs_param object."""
    m = re.match(r"\s*cs_param\s*:\s*", line, re.I)
    if not m or not line[m.end() :].startswith("{"):
        return False
    value, depth, quote, i = line[m.end() :].rstrip("\r\n"), [], "", 0
    while i < len(value):
        c = value[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c in "{[(":
            depth.append(c)
        elif c in "}])":
            if not depth or "{[(".index(depth.pop()) != "}])".index(c):
                return False
            if not depth:
                return bool(re.fullmatch(r"\s*[,;]?\s*(?://[^\r\n]*)?", value[i + 1 :]))
        i += 1
    return False


def test_isolated_lines(spark):
    rng = random.Random(6)
    pieces = ["{", "}", "[", "]", "(", ")", "'", '"', "`", "\\", "a", "é", "\U0001f511", ":", ",", ";", " ", "// c", "{}", "[]"]
    lines = ["cs_param: {" + "".join(rng.choice(pieces) for _ in range(rng.randrange(10))) + rng.choice(["", "}", "},", "}; // x", "} x"]) for _ in range(1500)]
    lines += ["cs_param: {}", " CS_Param :\t{a: [1, (2)]} ;\r\n", "cs_param {}", "x cs_param: {}", "cs_param: []", "cs_param: {a: '}'}", "cs_param: {a: '\\'}'}", "", "cs_param:", "cs_param: {a: {b: 1}} // {"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r.i: r.ok for r in df.select("i", rules.isolated(F.col("line")).alias("ok")).collect()}
    assert got == {i: scanned(x) for i, x in enumerate(lines)} and 50 < sum(got.values()) < 1400


def test_sanitised_texts(spark):
    good = 'cs_param: {u: "X-Access-Token"},'
    cases = [
        (None, "", 0, ""), ("", "", 0, ""), ("a\r\nb\rc", "a\nb\nc", 0, ""), (f"a\r\n{good}\r\nb\x0b{good}", "a\nb\x0b", 2, ""), (f"{good} {good}", "", 2, ""), ("x-access-token", None, 0, "ambiguous"),
        (f"{good}\nmy x-access-token", None, 0, "ambiguous"), (f"{good}\n-----BEGIN PRIVATE KEY-----", None, 0, "private_key"), ("Authorization: Bearer x", None, 0, "bearer"), ("npm_abcdefghijklmn", None, 0, "token"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "i int, t string")
    got = {r.i: (r.clean, r.removed, r.rejected) for r in rules.sanitized(df, "t").collect()}
    assert got == {i: tuple(x) for i, (_, *x) in enumerate(cases)}


def test_archives_through_files(spark, tmp_path):
    def packed(*members, kind=zipfile.ZIP_STORED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", kind) as z:
            for name, data in members:
                z.writestr(name, data)
        return out.getvalue()

    whole = packed(("a/sites.js", "text é"))
    lying = whole.replace(len("text é".encode()).to_bytes(4, "little"), (3).to_bytes(4, "little"))  # declares less than it holds
    cases = {"good": (whole, "text é"), "two": (packed(("a/sites.js", "x"), ("sites.js", "y")), None), "none": (packed(("b", "x")), None), "cut": (whole[20:], None), "half": (whole[: len(whole) // 2], None), "bomb": (packed(("sites.js", b"0" * 3_000_000), kind=zipfile.ZIP_DEFLATED), None), "lying": (lying, None), "latin": (packed(("sites.js", b"\xff")), None)}
    files = spark.createDataFrame([(f"{n}.zip", bytearray(c)) for n, (c, _) in cases.items()], "name string, content binary")
    folder = f"file://{tmp_path}/zips"
    assert sinks.write_files(spark, files.repartition(3), folder) == len(cases) == sinks.write_files(spark, files, folder)  # again: the same files
    read = spark.read.format("binaryFile").load(folder)
    assert read.count() == len(cases)
    got = {r.path.rsplit("/", 1)[1].removesuffix(".zip"): r.text for r in registries.zip_texts(spark, read, "sites.js").collect()}
    assert got == {n: t for n, (_, t) in cases.items()}
