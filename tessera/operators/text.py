"""Text, HTML and transcript transforms with table semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.series import c


def slugify(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def strip_tags(x) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c(x), r"<[^>]*>", " "), r"\s+", " "))


def decode_named(x) -> Column:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        x = F.replace(c(x), F.lit(f"&{name};"), F.lit(char))
    return x


def title(html) -> Column:
    return F.nullif(strip_tags(F.regexp_extract(c(html), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def word_count(x) -> Column:
    """Words of letters and digits, each CJK character a word of its own."""
    return F.regexp_count(F.coalesce(c(x), F.lit("")), F.lit(r"[A-Za-z0-9]+")) + F.regexp_count(F.coalesce(c(x), F.lit("")), F.lit(r"[\x{4e00}-\x{9fff}]"))


def iso_date(x) -> Column:
    return F.when(c(x).rlike(r"^\d{8}$"), F.regexp_replace(c(x), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(c(x))


def first_rule(x, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose text occurs."""
    out = None
    for needle, label in rules:
        hit = F.contains(F.lower(c(x)), F.lit(needle))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def stable_ids(items: DataFrame, known: DataFrame) -> DataFrame:
    """(code, name) keeps its known seq; new names of a code go on from its highest, in order of name."""
    top = known.groupBy("code").agg(F.max("seq").alias("top"))
    j = items.join(known, ["code", "name"], "left").join(top, "code", "left")
    fresh = F.row_number().over(Window.partitionBy("code", F.col("seq").isNull()).orderBy("name"))
    return j.select("code", "name", F.coalesce("seq", F.coalesce("top", F.lit(0)) + fresh).alias("seq"))


def best_version(df: DataFrame, key: str, score: Column, *ties: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(score.desc(), *ties)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def chunks(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """Lines packed greedily into chunks of at most `most` words (a longer line is a chunk of its own): key, chunk, words.
    One fold per document."""
    words = F.transform(F.split(c(text), "\n"), lambda s: F.regexp_count(s, F.lit(r"\S+")).cast("int"))
    kind = "struct<done:array<int>,now:int>"

    def step(a: Column, n: Column) -> Column:
        fits = (a["now"] + n <= most) | (a["now"] == 0)
        return F.when(fits, F.struct(a["done"].alias("done"), (a["now"] + n).alias("now"))).otherwise(F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), n.alias("now"))).cast(kind)

    packed = F.aggregate(words, F.from_json(F.lit('{"done":[],"now":0}'), kind), step, lambda a: F.concat(a["done"], F.array(a["now"])))
    return docs.select(key, F.posexplode(packed).alias("chunk", "words"))


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    parts = F.filter(F.transform(F.split(c(text), r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")
    return docs.select(key, F.posexplode(parts).alias("place", "sentence"))


def _clock(x: Column, at: str) -> Column:
    """Seconds of the clock time that follows `at`, hours optional."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(x, at + r"(?:(\d+):)?(\d+):(\d+)[.,](\d+)", k), F.lit("")), F.lit("0"))
    return part(1).cast("double") * 3600 + part(2).cast("double") * 60 + F.concat(part(3), F.lit("."), part(4)).cast("double")


def _one_line(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def web_vtt(x) -> Column:
    """Cues of a WebVTT text: array of (text, start, duration), tags and cue settings gone, empty cues left out."""
    blocks = F.split(F.regexp_replace(c(x), "\r\n?", "\n"), r"\n[ \t]*\n")

    def cue(b: Column) -> Column:
        start = _clock(b, "")
        said = _one_line(F.regexp_replace(F.regexp_extract(b, r"-->[^\n]*\n([\s\S]*)$", 1), r"<[^>]*>", ""))
        return F.struct(said.alias("text"), start.alias("start"), F.round(_clock(b, "-->[ ]*") - start, 3).alias("duration"))

    cues = F.transform(F.filter(blocks, lambda b: b.rlike(r"\d[.,]\d+[ \t]*-->")), cue)
    return F.filter(cues, lambda s: s["text"] != "")


def json3(x) -> Column:
    """Snippets of a timed-text JSON (events of tStartMs, dDurationMs and segs): array of (text, start, duration)."""
    events = F.from_json(c(x), "events array<struct<tStartMs: double, dDurationMs: double, segs: array<struct<utf8: string>>>>")["events"]
    text = lambda e: _one_line(F.array_join(F.transform(e["segs"], lambda g: g["utf8"]), ""))
    made = F.transform(events, lambda e: F.struct(text(e).alias("text"), (e["tStartMs"] / 1000).alias("start"), (F.coalesce(e["dDurationMs"], F.lit(0.0)) / 1000).alias("duration")))
    return F.filter(made, lambda s: s["text"] != "")


#: Track formats, best first.
TRACKS = ["json3", "srv3", "srv2", "srv1", "ttml", "vtt"]


def best_track(tracks) -> Column:
    """Of an array of (ext, url) the one of the best format; others come last."""
    place = lambda t: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TRACKS)), t["ext"]), F.lit(0)), F.lit(len(TRACKS) + 1))
    ranked = F.transform(c(tracks), lambda t, i: F.struct(place(t).alias("p"), i.alias("i"), t.alias("t")))
    return F.array_min(ranked)["t"]
