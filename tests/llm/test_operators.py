"""Each operator against a library, SQL or brute force, and on hostile rows."""

import base64
import random
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from auditloom.llm import ann, byte_bpe, decontaminate, html_extract, language_id, line_dedup, ngram_join, token_counts, toxicity, url_filters

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
ODD = ["", None, " ", "\n\n", "a", "é😀\n\tβ", "x" * 5000, "one two\nthree four\nfive six", " ".join(WORDS * 300), "<s> <|endoftext|> 's\x1c"]


@pytest.fixture(scope="module")
def texts():
    return [t.as_py() for t in pq.read_table(f"{SF}/documents.parquet").column("text")[:60]] + ODD


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows, a repeated id with two texts, extra columns with names that clash."""
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(ODD)]
    rows += [(3, "\n\n", "en"), (7, "another text\nof the same id", None), (None, "one two\nthree four\nfive six", "en"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in ("n_tokens", "score", "copy", "key", "hash", "pos", "c", "n_lines", "host", "token_ids", "items", "n_removed", "embedding", "constants")})


def test_prefix_counts_match_the_library(texts):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp, counter, rng = sentencepiece.SentencePieceProcessor(model_file=model), token_counts.PrefixCounter(model), random.Random(1)
    for t in texts:
        counts = np.cumsum(np.frombuffer(counter.steps(t), np.int16))
        assert len(counts) == len(t or "") and (counts[-1] if len(counts) else 0) == len(sp.encode(t or ""))
        for cut in rng.sample(range(1, len(t) + 1), min(5, len(t))) if t else ():
            assert counts[cut - 1] == len(sp.encode(t[:cut]))


def test_budget_answers(spark):
    df = spark.createDataFrame([(1, "hello wonderful world " * 50), (2, None)], "doc_id long, text string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = {r.doc_id: r for r in token_counts.token_counts(df, model, budget=10).collect()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    text = "hello wonderful world " * 50
    assert len(sp.encode(text[: out[1].fits])) <= 10 < out[1].n_tokens and out[1].over_limit
    assert all(len(sp.encode(text[:n])) > 10 for n in range(out[1].fits + 1, out[1].fits + 20))
    assert (out[2].n_tokens, out[2].fits, out[2].n_bytes, out[2].over_limit) == (0, 0, 0, False)


def test_byte_bpe_matches_the_library(texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own, library = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t, packed in zip(texts, own.packed_ids([t or "" for t in texts]), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(t or "")
        assert own.decoded(packed) == (t or "").encode()
    assert sorted(own.hash.slots(list(ranks)).tolist()) == list(range(len(ranks)))


def _sql(sql: str, tables: dict[str, str] | None = None) -> list[tuple]:
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(repr(sorted(zip(names, row, strict=True))) for row in cursor.fetchall())


@pytest.mark.parametrize(("query", "sql"), [(line_dedup.op2_line_dedup, line_dedup.OP2_SQL), (url_filters.op3_url_filters, url_filters.OP3_SQL), (ngram_join.op4_ngram_join, ngram_join.OP4_SQL), (decontaminate.op5_decontaminate, decontaminate.OP5_SQL)])
def test_queries_match_sql(spark, query, sql):
    assert sorted(repr(sorted(r.asDict().items())) for r in query(spark, SF).collect()) == _sql(sql)


def test_url_rules_by_literal_and_by_join(spark):
    urls = ["http://www.Example.com/en/x?q", "https://example.com/en/a", "http://x.net/es/1", "http://net/fr/", "http://example.com", "nonsense", None, "http://com/x", "ftp://a.b.net/de/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    literal, joined = (sorted(map(tuple, url_filters.judge_urls(df, url_filters.QUERY_RULES, max_literal_rules=n).select("page_id", "host", "path", "rule", "verdict").collect())) for n in (500, 0))
    assert literal == joined
    assert [r[3:] for r in literal] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/es/", "block"), ("net/fr/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), (None, "allow")]


def _brute_groups(rows):
    sets = {i: set(ngram_join.shingles(t).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((of(a), of(b)))
            root[y] = x
    return sorted((i, len(sets[i]), of(i)) for i in sets)


def test_groups_match_brute_force_on_a_family_of_edited_copies(spark):
    rng = random.Random(4)
    base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(150)]
    rows = []
    for i in range(250):
        words = [w if rng.random() > (i % 25) / 250 else f"new{rng.randint(0, 10**6)}" for w in base]
        rows.append((i, " ".join(words)))
    rows += [(300 + i, rows[i][1].upper() if i % 2 else rows[i][1]) for i in range(40)] + [(400, "short one"), (401, "SHORT  one"), (402, ""), (403, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.similar_groups(df).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == _brute_groups(rows)


def test_decontaminate_cuts_and_drops(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "keep " * 100 + "Q0, " + item[3:] + " tail"), (2, item), (3, "clean text"), (4, None), (5, "a short! item")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "short item"), (9, None), (None, "")], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    assert set(out) == {1, 3, 4} and out[1] == "keep " * 100 + "tail" and out[3] == "clean text" and out[4] is None


def test_html_is_read_without_its_surroundings():
    page = "<html><head><title>T</title></head><body><nav>menu</nav><div class='cookie-notice'>ok</div><article><h1>A &amp; B</h1><p>one <b>two\n three</b><p>four</article><div id=comments>no</div><footer>f</footer>"
    assert html_extract.page_text(page) == "A & B\none two three\nfour"
    assert html_extract.page_text(None) == html_extract.page_text("") == ""
    assert html_extract.page_text("<p>plain</p><p>blocks <foo") == "plain\nblocks"


def test_wrappers_align_optional_and_repeated_groups():
    a, b = html_extract.shape("<ul><li>1</li><li>2</li></ul><p>x</p>"), html_extract.shape("<ul><li>1</li></ul><h2>y</h2><p>x</p>")
    assert any(t.endswith(")+") for t in a)
    assert any(t.endswith(")?") for t in html_extract.aligned(a, b))


def test_neighbours_match_brute_force(spark):
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.op9_ann(spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = {(q, k): (v, s) for q, k, v, s in con.execute(ann.OP9_SQL).fetchall()}
    assert set(got) == set(want) and sum(got[k][0] == want[k][0] for k in want) >= 0.99 * len(want)


def test_vectors_that_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (1, [0.5, 0.5]), (2, [nan, 1.0]), (3, None), (4, [1.0, 0.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()]
    assert sorted(got) == [(0, 1, 4), (0, 2, 1)]


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    met = language_id.op10_language_id(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = met.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.9 * n


def test_toxicity_learns_and_tolerates_gaps(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(30)) + (rng.choice([" you idiot.", " such a moron."]) if i % 4 == 0 else ".")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    tests = spark.createDataFrame([(0, "alpha beta gamma delta idioot here"), (1, "alpha beta gamma"), (2, "you m o r o n there"), (3, None), (4, "")], "doc_id long, text string")
    out = {r.doc_id: r.predicted for r in toxicity.score_texts(tests, model).collect()}
    assert out == {0: 1, 1: 0, 2: 1, 3: 0, 4: 0}


def test_hostile_rows_crash_nothing(spark, odd):
    bench = spark.createDataFrame([(1, "one two\nthree four")], "item_id long, text string")
    model = language_id.fit(odd)
    for df in (odd, odd.limit(0)):
        n = df.count()
        args = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
        for out in (
            token_counts.token_counts(df, public_tokenizers.path("piece_bpe_32k.model")),
            line_dedup.dedup_lines(df),
            ngram_join.similar_groups(df),
            decontaminate.find_benchmark_passages(df, bench),
            byte_bpe.decode_documents(byte_bpe.encode_documents(df, *args), *args),
            language_id.identify(df, model),
            toxicity.score_texts(df, toxicity.fit(df, df.select("doc_id", F.lit(1).alias("toxic")))),
            url_filters.judge_urls(df, url_filters.QUERY_RULES, url="text"),
            html_extract.extract_main_text(df.withColumnRenamed("text", "html").withColumn("url", F.col("html"))),
        ):
            assert len(out.collect()) == n
