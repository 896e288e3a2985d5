"""License scans: statements, cosine and inheritance."""

import duckdb

from deliveryrisk.llm import licenses
from deliveryrisk.llm.queries import queries

PATH = "/root/testdata/sf0.001"
PROSE = "some ordinary words about the weather and the sea\n" * 20
FILES = [
    (1, "LICENSE", "Licensed under the Apache License, Version 2.0"),
    (2, "src/a.py", "print(1)"),
    (3, "src/lib/COPYING.txt", PROSE + "This work is licensed under the GNU General Public License, version 3."),
    (4, "/src//lib/b.py", PROSE),
    (5, "src/lib/deep/er/c.py", None),
    (6, "src/lib/d.py", PROSE + "Released under the MIT License.\n" + PROSE),
    (7, None, "no path"),
    (8, "src/e.py", ""),
    (8, "src/e.py", ""),
    (9, "other/f.py", "the license of a fishing boat is free of charge"),
    (10, "src/lib2/g.py", "x" * 100_000),
    (None, "h.py", "Released under CC0 1.0"),
]


def test_inheritance(spark):
    rows = [(*f, "clash", 0.1) for f in FILES]
    files = spark.createDataFrame(rows, "id long, path string, text string, license string, score double")
    got = sorted(
        ((r.file_id, r.own_license, r.is_license_file, r.license, r.inherited_from) for r in licenses.scan(files, "id", "path", "text").collect()),
        key=str,
    )
    apache, gpl = "Apache-2.0", "GPL-3.0"
    want = [
        (1, apache, True, apache, None),
        (2, None, False, apache, ""),
        (3, gpl, True, gpl, None),
        (4, None, False, gpl, "src/lib"),
        (5, None, False, gpl, "src/lib"),
        (6, "MIT", False, "MIT", None),
        (7, None, False, None, None),
        (8, None, False, apache, ""),
        (8, None, False, apache, ""),
        (9, None, False, apache, ""),
        (10, None, False, apache, ""),
        (None, "CC0-1.0", True, "CC0-1.0", None),
    ]
    # two license files in the root: the better score, then the first name
    assert got == sorted(want, key=str)
    assert licenses.scan(files.limit(0), "id", "path", "text").count() == 0


def test_skipped_lines_cannot_match():
    """A line without any anchor stays below the least cosine."""
    scanner = licenses.Scanner({"the": 900, "of": 800, "is": 700, "license": 5}, 1000)
    for vector in scanner.vectors:
        rest = [t for t in vector if t not in scanner.anchors]
        assert scanner.best(rest)[1] < licenses.LEAST
    for name, own in licenses.TEMPLATES.items():
        for text in own:
            assert scanner.scan("a line\n" + text)[0] == name


def test_whole_table(spark):
    """Statements that end texts, found by plain search."""
    said = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    got = {r.doc_id: r.own_license for r in queries()["op4_license_scan"](spark, PATH).collect()}
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{PATH}/documents.parquet'").fetchall():
        assert got[i] == next((said[line] for line in (text or "").split("\n") if line in said), None)
