"""Weighted keywords of each site: words and phrases scored by the zones they stand in. Native.

Ties go to the term that is seen first (page, zone, sentence, phrase length, position), then in the order of the terms. The stop list is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the zones, and the stop words.
ZONES = {"title": 5.0, "h1": 4.0, "description": 3.0, "h2": 2.0, "h3": 1.5, "body": 1.0}
STOP = tuple("""
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее её мне было вот от меня еще ещё нет о из
ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут
где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой
совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над
больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой
им более всегда конечно всю между это наш ваш ваши наши вашего вашей нашей наших вашу также которые который которая которых очень весь
всё свой своих мы вы ваш как так этот эта эти то это чтобы или либо ещё уже просто каждый любой свою своего своей наш
the and for with that this from you your are our was were have has not but all can will about into more also its it's his her they them
their what when which who how why use using get
""".split())


def zones(silver: DataFrame, body_chars: int | None = None) -> DataFrame:
    """site, page_id, zone_no, weight, text of the pages that open. The whole body, or its first body_chars characters (20,000 in the reference)."""
    level = lambda n: F.transform(F.filter("headings", lambda h: h["level"] == n), lambda h: h["text"])
    one = lambda c: F.array(F.coalesce(c, F.lit("")))
    texts = {"title": one(F.col("title")), "h1": F.col("h1"), "description": one(F.col("description")), "h2": level(2), "h3": level(3), "body": one(F.col("text") if body_chars is None else F.left("text", F.lit(body_chars)))}

    def zone(i: int, name: str) -> Column:
        return F.transform(texts[name], lambda t: F.struct(F.lit(i).alias("zone_no"), F.lit(ZONES[name]).alias("weight"), t.alias("text")))

    rows = F.flatten(F.array(*[zone(i, name) for i, name in enumerate(ZONES)]))
    opened = silver.where("coalesce(status, 200) = 200") if "status" in silver.columns else silver
    return opened.select("site", "page_id", F.explode(rows).alias("z")).select("site", "page_id", "z.*")


def terms(silver: DataFrame, stop: tuple[str, ...] = STOP, body_chars: int | None = None) -> DataFrame:
    """site, term, n (words in it), score, first: summed over a site with partial sums."""
    sentences = zones(silver, body_chars).select("site", "page_id", "zone_no", "weight", F.posexplode(F.split("text", r"[.!?;:()«»\"|•·—–\n]+")).alias("sentence", "text"))
    cleaned = F.filter(F.transform(F.split(F.translate(F.lower("text"), "ё", "е"), r"[^\p{L}0-9-]+"), lambda t: F.regexp_replace(t, "^-+|-+$", "")), lambda t: t != "")
    rows = sentences.withColumn("t", cleaned)
    digits = lambda t: t.rlike("^[0-9]+$")
    usable = lambda t: (F.length(t) >= 3) & ~t.isin(*stop) & ~digits(t)

    def grams(n: int) -> Column:
        last = F.size("t") - n
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        ends = lambda i: usable(F.get("t", i)) & usable(F.get("t", i + n - 1)) & ~F.exists(F.slice("t", i + 1, n), digits)
        return F.transform(F.filter(at, ends), lambda i: F.struct(F.lit(n).alias("n"), i.alias("pos"), F.array_join(F.slice("t", i + 1, n), " ").alias("term")))

    # the generator keeps filters from moving below it, where they would work out the terms again
    found = rows.select("site", "page_id", "zone_no", "sentence", "weight", F.explode_outer(F.concat(grams(1), grams(2), grams(3))).alias("g")).where("g is not null")
    seen = F.min(F.struct("page_id", "zone_no", "sentence", "g.n", "g.pos"))
    return found.groupBy("site", "g.term", "g.n").agg(F.sum("weight").alias("score"), seen.alias("first"))


def keywords(silver: DataFrame, words: int = 12, phrases: int = 10, stop: tuple[str, ...] = STOP, body_chars: int | None = None) -> DataFrame:
    """site, kind (word, phrase), rank, term, score: words by rounded score, phrases of score 3 or more relative to the best (100)."""
    scored = terms(silver, stop, body_chars).withColumn("kind", F.when(F.col("n") == 1, "word").otherwise("phrase")).where("kind = 'word' or score >= 3")
    of = Window.partitionBy("site", "kind")
    ranked = scored.withColumn("rank", F.row_number().over(of.orderBy(F.desc("score"), "first", "term"))).where(F.col("rank") <= F.when(F.col("kind") == "word", words).otherwise(phrases))
    shown = F.when(F.col("kind") == "word", F.floor(F.col("score") + 0.5)).otherwise(F.floor(100 * F.col("score") / F.max("score").over(of) + 0.5))
    return ranked.select("site", "kind", "rank", "term", shown.cast("int").alias("score"))
