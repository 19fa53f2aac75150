"""Contradictions between notes (CON-*): values in sentences about the same thing that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..store import written
from .joins import join_counted

#: Facts under one pair of stems that are met as one block.
BLOCK = 2048
#: Words beside a value that say nothing about it.
UNITS = r"^(days?|tag|tage|tagen|hours?|stunde|stunden|minutes?|minute|minuten|weeks?|woche|wochen|months?|monat|monate|monaten|years?|jahr|jahre|jahren|users?|nutzer|seats?|uhr|clock|eur|usd|chf|gbp|euro|euros|dollar|dollars|percent|prozent)$"
#: Words that fill a sentence.
FILLERS = ["now", "jetzt", "nun", "new", "neu", "neue", "neuen", "ab", "since", "seit", "every", "jeden", "jede", "jeder", "also", "auch", "only", "nur", "still", "noch"]
#: Kinds of values and their patterns.
VALUES = (
    ("time", r"(?<![A-Za-z0-9_])(?:[01]?\d|2[0-3]):[0-5]\d(?![A-Za-z0-9_])"),
    ("time", r"(?i)(?<![A-Za-z0-9_])(?:[01]?\d|2[0-3]) ?(?:uhr|o'clock)(?![A-Za-z0-9_])"),
    ("date", r"(?<![A-Za-z0-9_])\d{1,2}\.\d{1,2}\.\d{4}(?![A-Za-z0-9_])"),
    ("date", r"(?<![A-Za-z0-9_])\d{4}-\d{2}-\d{2}(?![A-Za-z0-9_])"),
    ("money", r"(?i)(?:(?:€|\$|£|(?<![A-Za-z0-9_])(?:EUR|USD|CHF|GBP)(?![A-Za-z0-9_])) ?(?:\d[\d.,']{0,15}\d|\d))|(?:(?:\d[\d.,']{0,15}\d|\d) ?(?:€|\$|£|(?:EUR|USD|CHF|GBP|euros?|dollars?)(?![A-Za-z0-9_])))"),
    ("percent", r"(?i)(?<![A-Za-z0-9_])\d{1,4}(?:[.,]\d{1,3})? ?(?:%|percent(?![A-Za-z0-9_])|prozent(?![A-Za-z0-9_]))"),
    ("amount", r"(?i)(?<![A-Za-z0-9_])\d{1,6}(?:[.,]\d{1,3})? ?(?:days?|tagen?|tage|hours?|stunden?|minutes?|minuten?|weeks?|wochen?|months?|monaten?|monate|years?|jahren?|jahre|users?|nutzer|seats?)(?![A-Za-z0-9_])"),
)


def sentences(content: Column) -> Column:
    """STR-18: sentences of 12 to 400 characters of the whole content, markup and the source line out."""
    c = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?m)^\s*—\s*(?:Source|Quelle):.*$", "")
    c = F.regexp_replace(c, r"[*_`#>|]+", " ")
    c = F.regexp_replace(c, r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", "$1")
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+(?=[A-ZÄÖÜ0-9])|\n+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(parts, lambda s: F.length(s).between(12, 400))


def stems(sentence: Column) -> Column:
    """STR-19: five letters of each meaningful word, distinct."""
    words = F.regexp_extract_all(F.lower(sentence), F.lit(r"[a-zäöüß]{3,}"), F.lit(0))
    real = F.filter(words, lambda w: ~w.isin(X.STOPWORDS) & ~w.isin(FILLERS) & ~w.rlike(UNITS))
    return F.array_distinct(F.transform(real, lambda w: F.substring(w, 1, 5)))


def _normal(kind: str, value: Column) -> Column:
    """DAT-06, MTH-07: one form for one value."""
    number = N.plain_number(F.regexp_extract(value, r"(\d[\d.,']*\d|\d)", 1))
    if kind == "time":
        hour = F.regexp_extract(value, r"^(\d{1,2})", 1).cast("int").cast("string")
        return F.concat(hour, F.lit(":"), F.when(value.contains(":"), F.regexp_extract(value, r":(\d\d)", 1)).otherwise("00"))
    if kind == "date":
        german = F.concat_ws("-", F.regexp_extract(value, r"(\d{4})$", 1), F.lpad(F.regexp_extract(value, r"\.(\d{1,2})\.", 1), 2, "0"), F.lpad(F.regexp_extract(value, r"^(\d{1,2})\.", 1), 2, "0"))
        return F.when(value.contains("."), german).otherwise(value)
    if kind == "percent":
        return F.concat(number, F.lit("%"))
    if kind == "amount":
        word = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1))
        unit = word
        for pattern, name in (("days?|tage?n?", "days"), ("hours?|stunden?", "hours"), ("minutes?|minuten?", "minutes"), ("weeks?|wochen?", "weeks"), ("months?|monate?n?", "months"), ("years?|jahre?n?", "years"), ("users?|nutzer|seats?", "seats")):
            unit = F.when(word.rlike(f"^({pattern})$"), name).otherwise(unit)
        return F.concat(number, F.lit(" "), unit)
    return number


def comparable(notes: DataFrame, most: int | None = None) -> DataFrame:
    """CON-02, SRC-24: live notes that nothing replaces, semantic or procedural, no part of a divided file; the newest ``most``."""
    rows = notes.where(F.col("deleted_at").isNull() & F.col("superseded_by").isNull() & F.col("type").isin("semantic", "procedural") & ~F.col("title").rlike(r"\s[—–-]\s\d+/([2-9]|\d{2,})$"))
    return rows if most is None else rows.orderBy(F.desc("updated_at"), "id").limit(most)


def facts(notes: DataFrame) -> DataFrame:
    """CON-01, CON-02: (id, title, updated_at, source, sentence, kind, value, norm, in_sentence, stems) of comparable notes.

    Comparable: live, not superseded, semantic or procedural, and no later part of a divided file. The last value of a
    range is no fact but counts as mentioned.
    """
    rows = comparable(notes)
    source = F.regexp_extract("content", r"(?m)—\s*(?:Source|Quelle):\s*(\S[^\n]*)$", 1)
    each = rows.select("id", "title", "updated_at", F.when(source != "", F.trim(source)).alias("source"), F.posexplode(sentences(F.col("content"))).alias("n", "sentence"))
    each = each.where(F.col("sentence").rlike(r"\d"))
    found = []
    for kind, pattern in VALUES:
        flag = "(?i)" if pattern.startswith("(?i)") else ""
        before = r"(?:\d\s*[-–—]\s*|\d\s+(?:to|bis|and|und)\s+)"
        hits = F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0))
        in_range = F.regexp_extract_all("sentence", F.lit(f"{flag}{before}({pattern.removeprefix(flag)})"), F.lit(1))
        found.append(_facts_of(kind, hits, in_range))
    out = each.withColumn("stems", stems(F.col("sentence"))).where(F.size("stems") >= 2).withColumn("all", F.concat(*found)).where(F.size("all") > 0)
    out = out.select("*", F.explode("all").alias("f")).where("NOT f.ranged")
    same = F.array_distinct(F.transform(F.filter("all", lambda x: x["kind"] == F.col("f.kind")), lambda x: x["norm"]))
    return out.select("id", "title", "updated_at", "source", "n", "sentence", "f.kind", "f.value", "f.norm", same.alias("in_sentence"), "stems")


def _facts_of(kind: str, hits: Column, ranged: Column) -> Column:
    return F.transform(hits, lambda v: F.struct(F.lit(kind).alias("kind"), F.trim(v).alias("value"), _normal(kind, F.trim(v)).alias("norm"), F.array_contains(ranged, v).alias("ranged")))


def _meetings(rows: DataFrame, posting: int | None, block: int) -> DataFrame:
    """(fx, fy, shared) of facts (fid, id, kind, norm, in_sentence, stems) of one kind, of unlike notes and with unlike
    values, that share two stems and half of the smaller set.

    If a set of n stems shares k or more with another, any n - k + 2 of its stems hold two of them. So the smaller set of a
    pair stands under each pair of its n - k + 2 rarest stems, the larger one under all its pairs, and they meet once, at the
    first two that they share. Pairs of stems that many facts have are dealt out: the larger sets as so many blocks.
    """
    each = rows.select("fid", "kind", F.explode("stems").alias("s"))
    df = written(each.groupBy("kind", "s").agg(F.count("*").alias("c")).where(F.lit(True) if posting is None else F.col("c") <= posting))
    ranked = join_counted(each, df.withColumn("df", F.col("c")), ["kind", "s"], each.count(), "c")
    held = ranked.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "s"))), lambda v: v["s"]).alias("held")).where(F.size("held") >= 2)
    n = F.size("stems")
    least = F.greatest(F.lit(2), F.ceil(n / 2).cast("int"))  # of the smaller set
    facts = rows.select("fid", "id", "kind", "norm", "in_sentence", n.alias("n"), least.alias("k")).join(held, "fid")
    facts = written(facts.withColumn("first", F.slice("held", F.lit(1), F.greatest(F.lit(0), F.size("held") - F.col("k") + 2))))

    def pairs(c: str) -> Column:
        return F.explode(F.flatten(F.transform(c, lambda s, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda t: F.struct(F.least(s, t).alias("s"), F.greatest(s, t).alias("t"))))))

    small = facts.where(F.size("first") >= 2).select("*", pairs("first").alias("p")).select("*", "p.s", "p.t").drop("p", "in_sentence")
    on = ["kind", "s", "t"]
    large = facts.select("fid", "kind", pairs("held").alias("p")).select("fid", "kind", "p.s", "p.t")
    asked = small.groupBy(*on).agg(F.count("*").alias("asked"))
    met = large.groupBy(*on).agg(F.count("*").alias("c")).where("c > 1").join(asked, on)
    met = written(met.select(*on, "c", F.ceil(F.col("c") / block).cast("bigint").alias("blocks"), "asked"))
    dealt = join_counted(large, met.select(*on, "c", "blocks"), on, large.count(), "c").withColumn("block", F.pmod(F.xxhash64("fid"), "blocks"))
    probes = join_counted(small.select("fid", *on), met.select(*on, F.col("asked").alias("c"), "blocks"), on, small.count(), "c")
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    about = facts.select("fid", F.struct("id", "norm", "in_sentence", "n", "k", "held", "first").alias("f"))
    x = probes.join(about, "fid").select(*on, "block", F.col("fid").alias("fx"), F.col("f").alias("x"))
    y = dealt.join(about, "fid").select(*on, "block", F.col("fid").alias("fy"), F.col("f").alias("y"))
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    differ = (F.col("x.id") != F.col("y.id")) & (F.col("x.norm") != F.col("y.norm"))
    differ = differ & ~F.array_contains("x.in_sentence", F.col("y.norm")) & ~F.array_contains("y.in_sentence", F.col("x.norm"))
    here = F.array_sort(F.slice(F.array_intersect("x.first", "y.held"), 1, 2)) == F.array("s", "t")
    shared = F.size(F.array_intersect("x.held", "y.held"))
    return x.join(y, [*on, "block"]).where(smaller & differ & here & (shared >= F.col("x.k"))).select("fx", "fy", shared.alias("shared"))


def contradictions(found: DataFrame, accepted: DataFrame | None = None, limit: int | None = 20, posting: int | None = None, block: int = BLOCK) -> DataFrame:
    """CON-03: pairs of notes with facts of one kind and different values about the same thing, one for each pair, newest first.

    Facts share at least two stems and half of the smaller set; neither sentence holds the other's value; sources differ.
    All such pairs are found. With ``posting``, stems that more facts of a kind have are passed over as too common to say
    anything.
    """
    rows = written(found.withColumn("fid", F.xxhash64("id", "n", "kind", "value")).dropDuplicates(["fid"]))
    met = _meetings(rows, posting, block)
    about = rows.select("fid", F.struct("id", "title", "sentence", "value", "norm", "updated_at", "source", "stems").alias("f"))
    both = met.join(about.select(F.col("fid").alias("fx"), F.col("f").alias("x")), "fx").join(about.select(F.col("fid").alias("fy"), F.col("f").alias("y")), "fy")
    a = F.col("x.id") < F.col("y.id")
    both = both.select("shared", F.when(a, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(a, F.col("y")).otherwise(F.col("x")).alias("y"))
    pairs = both.where(~F.coalesce(F.col("x.source") == F.col("y.source"), F.lit(False))).withColumn("a", F.col("x.id")).withColumn("b", F.col("y.id"))
    if accepted is not None:
        pairs = pairs.join(accepted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    one = pairs.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("shared"), "x.sentence", "y.sentence", "x.value", "y.value"))).where("r = 1")
    first = F.col("x.updated_at") >= F.col("y.updated_at")

    def side(name: str) -> Column:
        pick = F.when(first, F.col("x")).otherwise(F.col("y")) if name == "newer" else F.when(first, F.col("y")).otherwise(F.col("x"))
        return F.struct(*[pick[k].alias(k) for k in ("id", "title", "sentence", "value", "updated_at")]).alias(name)

    out = one.select(F.concat_ws("|", "a", "b").alias("key"), side("newer"), side("older"), F.array_join(F.slice(F.array_sort(F.array_intersect("x.stems", "y.stems")), 1, 4), " ").alias("about"))
    out = out.orderBy(F.desc("newer.updated_at"), "key")
    return out.limit(limit) if limit else out
