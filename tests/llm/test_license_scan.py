"""Operator 12: base places against SQL, gates and suppression against brute force, known notices."""

import random
import re

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from auditloom.llm import license_rules, license_scan

SF = "/root/testdata/sf0.01"
RULES = license_rules.rules()

BASE_SQL = """
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
p(words, label) as (values (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
f as (select doc_id, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1 : i + len(words)] = words)) as at, label from w cross join p)
select w.doc_id, len(ws) as n_words, count(f.at) as n_base, min(f.at) as first_word, max(f.at) as last_word, coalesce(string_agg(distinct label, ',' order by label), '') as base_labels
from w left join f using (doc_id) group by all
"""


def test_base_equals_sql(spark):
    found = license_scan.op12_license_scan(spark, SF).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(BASE_SQL).fetchall())
    assert sorted(map(tuple, found.collect())) == want and sum(r[2] for r in want) > 5


def test_hundreds_of_rules_all_gated():
    assert len(RULES) > 300 and all(r.clauses for r in RULES)
    assert [license_rules.RANKS[r.kind] for r in RULES] == sorted((license_rules.RANKS[r.kind] for r in RULES), reverse=True)


def _example(rule: str, rng: random.Random) -> str:
    """A text that a rule in its notation fits: groups and repetitions filled in at random."""
    versions = lambda m: rng.choice([" version ", " v", " v ", " "]) + m[1]
    rule = re.sub(r"\(\?: version\| v\)\?\(\?: ([^()]*(?:\(\?:[^()]*\)\?)?)\)\?", lambda m: rng.choice(["", versions(m)]), rule)
    rule = re.sub(r"\(\?: version\| v\)\? (\d)", versions, rule)
    rule = rule.replace(r"\S+", "stuff").replace(r"\w+", "ing")
    while m := re.search(r"\((?:\?:)?([^()]*)\)(\?|\{(\d),\d+\})?", rule):
        n = int(m[3]) + rng.randint(0, 2) if m[3] else rng.randint(0, 1) if m[2] else 1
        rule = rule[: m.start()] + "".join(rng.choice(m[1].split("|")) for _ in range(n)) + rule[m.end() :]
    rule = re.sub(r"\[([^]]*)\]", lambda m: m[1][0], rule)
    return re.sub(r"(.)\?", lambda m: rng.choice([m[1], ""]), rule)


def _notations():
    for label, ids, name, address in license_rules._fields(license_rules.LICENSES):
        yield from ((label, f"spdx license identifier {ids}"), (label, name), (label, f"licensed under the {name}"), (label, f"license {ids}"))
        if address:
            yield label, address
    yield from (tuple(x) for x in license_rules._fields(license_rules.SIGNATURES) + license_rules._fields(license_rules.HINTS))


def test_every_rule_fits_its_own_examples_through_the_gate():
    rng, scanner = random.Random(2), license_scan.default_scanner()
    by_regex = {r.regex: i for i, r in enumerate(RULES)}
    for label, notation in _notations():
        i = by_regex.get(license_rules.compiled(notation))
        for _ in range(6):
            text = _example(notation, rng)
            assert re.search(license_rules.compiled(notation), text), (notation, text)
            assert i is None or i in scanner.candidates(text), (notation, text)
            shown = text.upper().replace(" ", rng.choice([" ", "\n * ", "-"]))
            assert scanner.scan(f"x {shown} y")[2], (notation, shown)


def _ungated(text):
    flat = (text or "").encode().translate(license_scan.ASCII_LOWER).decode("latin-1")
    found = [license_scan.Found(r.kind, r.label, m.start(), m.end()) for r in RULES for m in re.finditer(r.regex, flat)]
    rank = license_rules.RANKS
    within = lambda x, y: y.start <= x.start and x.end <= y.end
    wins = lambda y, j, x, i: (rank[y.kind], y.end - y.start, -j) > (rank[x.kind], x.end - x.start, -i)
    return [x for i, x in enumerate(found) if not any(within(x, y) and wins(y, j, x, i) for j, y in enumerate(found) if i != j)]


def test_gates_and_suppression_equal_brute_force():
    rng = random.Random(3)
    texts = [t.as_py() for t in pq.read_table(f"{SF}/documents.parquet").column("text")[:80]]
    parts = [_example(n, rng) for _, n in _notations()]
    texts += [" ".join(rng.choice(parts) + rng.choice(["", ".", " foo", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    scanner = license_scan.default_scanner()
    for t in texts:
        want = sorted((x.label, x.kind) for x in _ungated(t))
        assert sorted((x[0], x[1]) for x in scanner.scan(t)[2]) == want


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance", {"apache-2.0"}),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0-or-later"}),
        ("see https://creativecommons.org/licenses/by-sa/3.0/ for terms", {"cc-by-sa-3.0"}),
        ("Permission is hereby granted, free\n# of charge, to any person obtaining a copy of this software", {"mit"}),
        ("the GNU Lesser General Public License v2.1 or (at your option) any later version", {"lgpl-2.1-or-later"}),
        ("gnu general public license", set()),
        ("limited liability, permitted use, commitment", set()),
    ],
)
def test_known_notices(text, labels):
    assert {x[0] for x in license_scan.default_scanner().scan(text)[2]} == labels


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "MIT-License é MIT license"), (3, "MIT-License é MIT license"), (None, "cc by"), (4, "mit license " * 30_000), (5, "apache apache license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("base", "n_words", "detections", "__scan", "labels")})
    found = {(r.doc_id, r.text and len(r.text)): r for r in license_scan.scan_licenses(df).collect()}
    words = lambda r: [(b.label, b.word) for b in r.base]
    assert (found[1, None].n_words, words(found[1, None])) == (0, []) == (found[2, ""].n_words, words(found[2, ""]))
    assert words(found[3, 25]) == [("mit", 0), ("mit", 3)] and found[3, 25].n_words == 5
    assert found[4, 360_000].n_words == 60_000 and len(found[4, 360_000].base) == 30_000
    assert words(found[None, 5]) == [("cc-by", 0)] and words(found[5, 21]) == [("apache", 1)]
    assert license_scan.scan_licenses(df.limit(0)).collect() == []


def test_query_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "CC-BY 4.0 and cc by")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in license_scan.op12_license_scan(spark, str(tmp_path)).collect()}
    assert tuple(found[1])[1:] == (0, 0, None, None, "", "", 0.0)
    assert tuple(found[2])[1:] == (7, 2, 0, 5, "cc-by", "cc-by,cc-by-4.0", 0.8)
