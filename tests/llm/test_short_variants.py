"""Short texts with frequent shingles: no more shared shingles may be asked for than similarity needs."""

import random
from itertools import combinations

import pyarrow as pa
import pytest

from auditloom.llm import ngram_join


def _brute_groups(rows):
    sets = {i: set(ngram_join.shingles(t).tolist()) for i, t in rows}
    label = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if label[a] != label[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            least, most = sorted((label[a], label[b]))
            label = {i: least if x == most else x for i, x in label.items()}
    return sorted((i, len(sets[i]), label[i]) for i in sets)


@pytest.mark.parametrize("n", range(1, 30))
def test_no_class_is_asked_for_more_than_similarity_needs(n):
    found = [[{"token": t, "df": 10_000} for t in range(n)]]
    kinds = [("key", pa.int64()), ("n", pa.int64()), ("found", pa.list_(pa.struct([("token", pa.int64()), ("df", pa.int64())])))]
    batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(([0], [n], found), kinds, strict=True)], [k for k, _ in kinds])
    (out,) = ngram_join._prefixes(80, ngram_join.MOST_MATCHES)(iter([batch]))
    asked, prefix = out.column("matches")[0].as_py(), out.column("prefix")[0].as_py()
    assert asked <= -(-n * 80 // 100) and len(prefix) == n - -(-n * 80 // 100) + asked


def test_variants_of_short_texts_match_brute_force(spark):
    rng, rows = random.Random(11), []
    for length in range(8, 18):
        base = [f"w{length}x{k}" for k in range(length)]
        for i in range(60):
            rows.append((1000 * length + i, " ".join([*base, f"tail{length}x{i}"])))  # J = (n - 1) / (n + 1) to each other, (n - 1) / n to the base
        for i in range(10):
            edited = base[:]
            edited[rng.choice([0, -1])] = f"edit{i}"
            rows.append((1000 * length + 500 + i, " ".join(edited)))
        rows.append((1000 * length + 900, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.similar_groups(df).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == _brute_groups(rows)
