"""Planted passages of few lines between differing lines, against brute force over all runs of lines."""

import random

import corpus_pipeline
from auditloom.llm import line_dedup


def _brute(rows):
    split = {d: t.split("\n") for d, t in rows if t is not None}
    gone = {d: set() for d in split}
    seen = {}
    for d in sorted(split):
        lines = split[d]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(lines[a : b + 1])
                if sum(len(x.split()) for x in run) < 50 or not lines[a].split() or not lines[b].split():
                    continue
                if run in seen and not (seen[run][0] == d and seen[run][2] >= a):
                    gone[d] |= set(range(a, b + 1))
                seen.setdefault(run, (d, a, b))
    kept = {d: "\n".join(x for i, x in enumerate(lines) if i not in gone[d]) for d, lines in split.items()}
    return {d: t for d, t in kept.items() if not gone[d] or t.split()} | {d: None for d, t in rows if t is None}


def _rows():
    rng = random.Random(2)
    own = lambda tag: " ".join(f"{tag}w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 12)))
    rows = []
    for k in range(2, 6):
        for trial in range(6):
            passage = [" ".join(f"p{k}t{trial}l{i}x{j}" for j in range(60 // k + 1)) for i in range(k)]
            if trial % 2:
                passage.insert(1, "")
            for copy in range(3):
                before, after = [own("b") for _ in range(rng.randint(0, 3))], [own("a") for _ in range(rng.randint(0, 3))]
                rows.append((len(rows), "\n".join([*before, *passage, *after])))
    rows += [(900, "\n".join(["ten words of one line that is said many times"] * 17)), (901, ""), (902, None), (903, "\n\n"), (904, rows[0][1] + "\n" + rows[0][1])]
    return rows


def test_planted_passages_go_whole(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_passages(df).collect()}
    assert got == _brute(rows)


def test_the_pipeline_drops_them(spark):
    rows = _rows()
    out = corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    texts = [r.text or "" for r in out.collect()]
    for k in range(2, 6):
        for trial in range(6):
            for line in range(k):
                assert sum(f"p{k}t{trial}l{line}x0 " in t for t in texts) == 1
