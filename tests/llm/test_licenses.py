import re

from folio.llm import license_scan

#: Lines of the test table that name a licence, and their families.
KNOWN = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0"}
WRAPPED = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files (the Software)"
PLANTED = [
    (1, "Some prose.\n\n(c) 2020 A. Body. All rights reserved.\nMore prose.", "Proprietary"),
    (2, "Words before.\n" + WRAPPED + "\nWords after."),
    (3, "He spoke of the GNU General Public License at dinner.\nAll the rights of the reserved forest."),
    (4, "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    (5, None), (6, ""), (7, "\n\n"), (None, "Released under the MIT License."), (8, "x " * 200_000),
]


def test_recall_on_lines_of_the_table_and_planted_notices(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    planted = spark.createDataFrame([(None if p[0] is None else p[0] + 10**6, p[1]) for p in PLANTED], "doc_id long, text string")
    rows = license_scan.license_scan(docs.union(planted)).collect()
    found = {(r["doc_id"], r["paragraph_no"]): r["family"] for r in rows}
    want = {(d, i): KNOWN[line] for d, t in texts.items() for i, line in enumerate(re.split("\r\n|\r|\n", t)) if line in KNOWN}
    assert len(want) > 30 and sum(found.get(k) == f for k, f in want.items()) >= 0.9 * len(want)
    assert sum(d is not None and d < 10**6 and (d, i) not in want for d, i in found) <= 0.1 * len(want)
    own = {(d - 10**6 if d else d, i): f for (d, i), f in found.items() if d is None or d >= 10**6}
    assert own == {(1, 2): "proprietary", (2, 1): "mit", (4, 0): "lgpl", (None, 0): "mit"}
    assert license_scan.license_scan(docs.limit(0)).count() == 0
