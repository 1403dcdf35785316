"""Personal data by bootstrapped contextual extraction.

Seeds are identifiers with a form of their own (e-mail and IP addresses, card
and telephone numbers), found by fixed expressions inside rows.  Identifier-like
words (with a digit or an at sign) are read with the words to their left; a
pattern is the pair of words before such a word.  Patterns and instances form a
graph that Spark scores in turns: an instance is as credible as the mean of its
patterns (a seed is certain), a pattern as credible as the smoothed mean of its
instances.  Instances of patterns above the threshold, supported by enough
different seeds, are reported with the kind most of the pattern's seeds have.

Everything is DataFrame work.  One pass over the text leaves a narrow table
(ids, spans, identifier-like words and their contexts), which is checkpointed;
the graph is aggregated before it is shuffled.  The expressions use possessive
quantifiers and start only where a run of their characters starts, so they are
linear in the text.

Defined results: a null or empty text has no spans; positions are code points,
end exclusive; base matches are leftmost and non-overlapping within a kind and
may overlap across kinds; learned spans that overlap a base span are left out;
repeated rows get the same spans; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import cut_lineage, row_key

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# the same matches as the plain expressions: a match can only start where a run
# of its first characters starts or where the match before it ended
FORMS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# cheap tests that every text with a match of the kind passes
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[ -]?[0-9]){13}")),
    "phone": lambda t: F.rlike(t, F.lit(r"\+[0-9]")),
}
# a word that holds a digit or an at sign
WORD = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
BLOCK = 256  # matches whose positions are summed together
SPAN = "struct<start:int,end:int,value:string,gap:string>"


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once (inside a lambda an outer
    expression would be worked out again for every element)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(values: Column) -> Column:
    """0 and the running sums of the numbers."""
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))


def _located(text: Column, form: str) -> Column:
    """All matches as array<struct<start, end, value, gap>>; gap is the text
    between the match before (or the start of the text) and this one.

    Starts are running sums: within blocks of matches, then over the blocks'
    totals, so that no array is appended to more than a few hundred times.
    """
    between, found = F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0))
    pairs = F.transform(F.arrays_zip(F.transform(between, lambda g: F.struct(g.alias("gap"))).alias("g"),
                                     found.alias("value")), lambda p: F.struct(
        p["g"]["gap"].alias("gap"), p["value"].alias("value"), F.length(p["g"]["gap"]).alias("gap_n"),
        F.length(p["value"]).alias("n")))

    def in_block(z: Column) -> Column:
        before = F.slice(_running(F.transform(z["b"], lambda p: p["gap_n"] + p["n"])), F.lit(1), F.size(z["b"]))
        return F.transform(F.arrays_zip(z["b"].alias("p"), before.alias("before")), lambda m: F.struct(
            (z["first"] + m["before"] + m["p"]["gap_n"]).alias("start"),
            (z["first"] + m["before"] + m["p"]["gap_n"] + m["p"]["n"]).alias("end"),
            m["p"]["value"].alias("value"), m["p"]["gap"].alias("gap")))

    def whole(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, p: a + p["gap_n"] + p["n"]))
        firsts = F.slice(_running(totals), F.lit(1), F.size(blocks))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), firsts.alias("first")), in_block))

    def of(found_pairs: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(found_pairs), F.lit(BLOCK)),
                          lambda i: F.slice(found_pairs, i, F.lit(BLOCK)))
        return F.when(F.size(found_pairs) > 0, _let(cut, whole)).otherwise(F.array().cast(f"array<{SPAN}>"))

    # the piece after the last match has no value
    return _let(F.filter(pairs, lambda p: p["value"].isNotNull()), of)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of digits, every second from the right doubled, divisible by ten."""
    each = F.split(F.reverse(digits), "")
    weighed = F.transform(F.filter(each, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def _small_number(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(F.substring(bare, 1, 3).try_cast("int"), F.lit(0)) <= 255)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small_number)
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (number), end, value>> of all kinds, by start and kind."""
    none = F.array().cast(f"array<{SPAN}>")

    def of_kind(n: int, kind: str) -> Column:
        found = F.when(HINTS[kind](text), _located(text, FORMS[kind])).otherwise(none)
        return F.transform(F.filter(found, lambda s: _valid(kind, s["value"])), lambda s: F.struct(
            s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    return F.array_sort(F.concat(*(of_kind(n, k) for n, k in enumerate(KINDS))))


def _candidates(text: Column) -> Column:
    """Identifier-like words, trimmed of punctuation, with the two words before them:
    array<struct<start, end, value, pattern>>."""
    def trimmed(w: Column) -> Column:
        raw = w["value"]
        head = F.length(raw) - F.length(F.regexp_replace(raw, "^[^A-Za-z0-9+]+", ""))
        core = F.regexp_replace(F.regexp_replace(raw, "^[^A-Za-z0-9+]+", ""), r"[^A-Za-z0-9]+$", "")
        left = F.filter(F.split(F.lower(F.substring(w["gap"], -200, 200)), r"[^\p{L}]+"), lambda x: x != "")
        start = w["start"] + head
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"),
                        F.when(F.size(left) >= 2, F.array_join(F.slice(left, -2, 2), " ")).alias("pattern"))

    shaped = F.transform(_located(text, WORD), trimmed)
    like = F.filter(shaped, lambda c: F.contains(c["value"], F.lit("@")) | (F.length(_digits(c["value"])) >= 4))
    return F.when(F.rlike(text, F.lit("[0-9@]")), like).otherwise(
        F.array().cast("array<struct<start:int,end:int,value:string,pattern:string>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, base, words): what one pass over the texts finds, checkpointed."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(docs).alias("key"), text.alias("text"))
    return cut_lineage(src.select("id", "key", base_spans(F.col("text")).alias("base"),
                                  _candidates(F.col("text")).alias("words")))


def _overlaps(word: Column, span: Column) -> Column:
    return (word["start"] < span["end"]) & (span["start"] < word["end"])


def occurrences(scanned: DataFrame) -> DataFrame:
    """(id, key, start, end, value, pattern, kind): identifier-like words with a
    context; kind is that of the base span the word overlaps, else null."""
    rows = scanned.select("id", "key", "base", F.explode("words").alias("w")).where(F.col("w.pattern").isNotNull())
    hit = F.filter("base", lambda s: _overlaps(F.col("w"), s))
    return rows.select("id", "key", F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                       F.col("w.value").alias("value"), F.col("w.pattern").alias("pattern"),
                       F.get(hit, F.lit(0))["kind"].alias("kind"))


def score_patterns(found: DataFrame, rounds: int = 3, prior: float = 1.0) -> DataFrame:
    """(pattern, score, seeds, kind) from the pattern-instance graph."""
    edges = cut_lineage(found.groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    seeds = edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").alias("n")).groupBy("pattern").agg(
        F.sum("n").alias("seeds"), F.max_by("kind", F.struct("n", -F.col("kind"))).alias("kind"))
    # an instance known as a seed anywhere is certain everywhere
    belief = edges.groupBy("value").agg(F.max(F.col("kind").isNotNull().cast("double")).alias("belief"))
    for _ in range(rounds):
        scores = edges.join(belief, "value").groupBy("pattern").agg(
            (F.sum("belief") / (F.count("*") + F.lit(prior))).alias("score"))
        certain = F.max(F.col("kind").isNotNull().cast("double"))
        belief = cut_lineage(edges.join(scores, "pattern").groupBy("value").agg(
            F.greatest(certain, F.avg("score")).alias("belief")))
    scores = edges.join(belief, "value").groupBy("pattern").agg(
        (F.sum("belief") / (F.count("*") + F.lit(prior))).alias("score"))
    return scores.join(seeds, "pattern")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7,
                  min_seeds: int = 3, rounds: int = 3) -> DataFrame:
    """One row per document: (id, base, learned), arrays of struct<start, kind,
    end, value> with kind a number of ``KINDS``."""
    scanned = scan(docs, id_col, text_col)
    found = occurrences(scanned)
    good = score_patterns(found, rounds).where((F.col("score") >= threshold) & (F.col("seeds") >= min_seeds)).select(
        "pattern", F.col("kind").alias("pattern_kind"))
    new = found.where(F.col("kind").isNull()).join(good, "pattern").groupBy("id", "key").agg(F.array_sort(
        F.collect_set(F.struct("start", F.col("pattern_kind").alias("kind"), "end", "value"))).alias("learned"))
    new = new.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "learned")
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return scanned.join(new, on, "left").select(F.col("id").alias(id_col), "base",
                                                F.coalesce("learned", none).alias("learned"))


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
