r"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram over character classes and its histogram over common words are compared with each language's reference by the
Jensen-Shannon distance (the root of the divergence to base 2; 0 to 1). References are the histograms of all labelled documents of the
language added up, each document weighted by its own size up to ``WEIGHT_WORDS`` words, so that no long text makes the reference alone,
and ``PRIOR_WORDS`` words spread like those of all languages, which count where documents are few. A document is judged by the language
that suits it best; its own label plays no part. Short documents say too little about a distribution: the class histogram is judged from
``MIN_CHARS`` characters in words on, the word histogram, which is over the common words alone, from ``MIN_COMMON`` of them on. From
``MIN_WORDS`` words on, a document's common words must make up ``LEAST_COMMON`` of the share they have in the reference at least. Common
words are looked for among runs of letters, so that marks beside them do not hide them.

All per-document work is inside one row and takes time in proportion to the text; what is gathered is one histogram for each of the
``MOST_LABELS`` most frequent labels.
"""

from __future__ import annotations

import json

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import materialise, quoted, require

#: Frequent words of English, French, German and Spanish. Words outside all lists are one more class.
COMMON = {
    "en": "the of and to in is that it was for on are as with be at by this from or an not but have had",
    "fr": "le la les de des du et un une en que qui dans pour pas sur au par il elle ne se est ce plus",
    "de": "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es an er so dass bei",
    "es": "el la los de que y en un una por con no se su para es al lo como las del mas o pero sus",
}
COMMON_WORDS = sorted({w for words in COMMON.values() for w in words.split()})
#: Character classes by Java pattern, of the characters in words. No character is in two; what is in none is the last class.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "stop": ".,;:!?'\"()-", "symbol": "#*$%&|<>", "latin": "À-ɏ"}
WINDOW = 8
WEIGHT_WORDS = 1000
MIN_CHARS = 200
MIN_WORDS = 60
MIN_COMMON = 30
MOST_CLASS_DISTANCE = 0.32
MOST_WORD_DISTANCE = 0.60
LEAST_COMMON = 0.25
LEAST_WORDS = 20
MOST_REPEATED = 30
PRIOR_WORDS = 200
MOST_LABELS = 200

_SPACE = r"[\x20\x09-\x0D]+"


def _word_slots(words: list[str]) -> int:
    """The smallest table size at which no two words' hashes fall into one slot."""
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    return next(n for n in range(len(words), 1 << 20) if len({h % n for h in signed}) == len(words))


def _slot(word: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(slots)).cast("int")


def _coded(words: Column) -> Column:
    """The common ones among the words as one character each, side by side."""
    slots = _word_slots(COMMON_WORDS)
    held, marks = [""] * slots, [""] * slots
    for k, w in enumerate(COMMON_WORDS):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        at = (h - (1 << 64) if h >> 63 else h) % slots
        held[at], marks[at] = w, chr(k + 1)
    table, letters = F.array(*map(F.lit, held)), F.array(*map(F.lit, marks))
    common = F.filter(words, lambda w: F.get(table, _slot(w, slots)) == w)
    return F.array_join(F.transform(common, lambda w: F.get(letters, _slot(w, slots))), "")


def _paired(codes: str, step: int) -> Column:
    """Hashes of each code with the one some places on."""
    c = F.col(codes)
    return F.transform(F.slice(c, 1, F.greatest(F.size(c) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(c, i + step)))


def measures(docs: DataFrame, label: str = "lang") -> DataFrame:
    """Per row of docs: doc_id, label, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_tokens, classes, commons (arrays of counts).

    n_tokens counts the runs of letters, among which commons are.
    """
    text = F.coalesce("text", F.lit(""))
    words = lambda t, p: F.filter(F.split(t, p, -1), lambda w: w != "")
    df = docs.select("doc_id", F.col(quoted(label)).cast("string").alias("label"), text.alias("text"))
    df = df.select(
        "doc_id", "label", F.transform(words(F.col("text"), _SPACE), lambda w: F.xxhash64(w)).alias("codes"),
        words(F.lower("text"), r"[^\p{L}]+").alias("tokens"), F.regexp_replace("text", _SPACE, "").alias("left0"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    # the hash of eight words comes from hashes of two and of four
    df = df.select("*", _paired("codes", 1).alias("two")).select("*", _paired("two", 2).alias("four")).select("*", _paired("four", 4).alias("eight"))
    names = list(CLASSES)
    for k, name in enumerate(names):
        df = df.withColumn(f"left{k + 1}", F.regexp_replace(f"left{k}", f"[{CLASSES[name]}]+", ""))
    # places that start a window found twice or more, in order: neighbours in the order of (hash, place)
    repeated = F.when(F.size(F.array_distinct("eight")) < F.size("eight"), F.array_sort(F.transform("eight", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.expr("cast(array() as array<struct<h: bigint, i: int>>)"))
    df = df.select(
        "doc_id", "label", F.size("codes").alias("n_words"), F.size("tokens").alias("n_tokens"), _coded(F.col("tokens")).alias("coded"), repeated.alias("sorted"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), *(F.length(f"left{k}").alias(f"left{k}") for k in range(len(names) + 1)),
    )
    df = df.withColumn("at", F.expr("array_sort(transform(filter(sorted, (x, k) -> x.h = get(sorted, k - 1).h or x.h = get(sorted, k + 1).h), x -> x.i))"))
    covered = F.expr(f"aggregate(transform(at, (p, k) -> least({WINDOW}, coalesce(get(at, k + 1) - p, {WINDOW}))), 0, (a, x) -> a + x)")
    classes = F.array(*(F.col(f"left{k}") - F.col(f"left{k + 1}") for k in range(len(names))), F.col(f"left{len(names)}"))
    commons = F.array(*(F.length("coded") - F.length(F.replace("coded", F.lit(chr(k + 1)), F.lit(""))) for k in range(len(COMMON_WORDS))), F.col("n_tokens") - F.length("coded"))
    symbol = names.index("symbol")
    return df.select(
        "doc_id", "label", F.col("n_words").cast("long").alias("n_words"), F.col("left0").cast("long").alias("word_chars"), (F.col(f"left{symbol}") - F.col(f"left{symbol + 1}")).cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), F.col("n_tokens").cast("long").alias("n_tokens"),
        classes.cast("array<long>").alias("classes"), commons.cast("array<long>").alias("commons"),
    )


def references(measured: DataFrame, prior: int = PRIOR_WORDS, most_labels: int = MOST_LABELS) -> list[dict]:
    """Histograms of each label's documents: lang, classes, commons as shares with prior words of all labels and one count added to each."""
    weight = f"least(1.0D, {WEIGHT_WORDS} / greatest(n_tokens, 1))"
    names = [("classes", len(CLASSES) + 1), ("commons", len(COMMON_WORDS) + 1)]
    sums = [F.expr(f"sum(cast(floor(1000 * {a}[{k}] * {weight}) as bigint)) / 1000").alias(f"{a}{k}") for a, n in names for k in range(n)]
    rows = measured.where(F.col("label").isNotNull() & (F.col("n_words") >= LEAST_WORDS)).groupBy("label").agg(F.count("*").alias("n_documents"), *sums).orderBy(F.desc("n_documents"), "label").limit(most_labels).collect()
    pooled = {f"{a}{k}": sum(r[f"{a}{k}"] for r in rows) for a, n in names for k in range(n)}
    scale = prior / max(1.0, sum(pooled[f"commons{k}"] for k in range(len(COMMON_WORDS) + 1)))
    out = []
    for r in sorted(rows, key=lambda r: r["label"]):
        ref = {"lang": r["label"]}
        for a, n in names:
            counts = [round(r[f"{a}{k}"] + scale * pooled[f"{a}{k}"]) + 1 for k in range(n)]
            ref[a] = [c / sum(counts) for c in counts]
        out.append(ref)
    return out


def distance(counts: Column, total: Column, shares: Column) -> Column:
    """The Jensen-Shannon distance between an array of counts and an array of shares, none of which is zero."""
    pairs = F.zip_with(counts, shares, lambda c, q: F.struct((c / F.greatest(total, F.lit(1))).alias("p"), q.alias("q")))
    term = lambda x: F.when(x["p"] > 0, x["p"] * F.log2(2 * x["p"] / (x["p"] + x["q"])) + x["q"] * F.log2(2 * x["q"] / (x["p"] + x["q"]))).otherwise(x["q"])
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + term(x)) / 2))


def judge(docs: DataFrame, label: str = "lang") -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, class_distance, word_distance (rounded to six places), like_lang.

    kept is false if the base rules fail, if the class histogram or the word histogram is farther from the best language than allowed, or
    if common words are too rare for it. Of languages equally near the first by name counts.
    A null text has no words and fails the base rules. Without references, for want of labels, only the base rules count. Repeated rows
    and rows without id each give a row. Texts of any length are measured whole; other columns of docs are not read, whatever their names. An
    empty table gives an empty result.
    """
    require(docs, ["doc_id", "text", label])
    measured = materialise(measures(docs, label))
    refs = references(measured)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    n_common = F.col("n_tokens") - F.element_at("commons", -1)
    # the last place of commons is the class of all other words
    told = []
    for r in refs:
        mass = sum(r["commons"][:-1])
        told.append({"lang": r["lang"], "classes": r["classes"], "alone": [x / mass for x in r["commons"][:-1]], "mass": mass})
    known = F.from_json(F.lit(json.dumps(told)), "array<struct<lang: string, classes: array<double>, alone: array<double>, mass: double>>")
    met = measured.select("*", n_common.alias("n_common"), F.slice("commons", 1, len(COMMON_WORDS)).alias("met"))
    scored = met.select("*", F.transform(known, lambda r: F.struct(distance(F.col("classes"), F.col("word_chars"), r["classes"]).alias("c"), distance(F.col("met"), F.col("n_common"), r["alone"]).alias("w"), r["mass"].alias("m"), r["lang"].alias("lang"))).alias("scores"))
    best = F.array_min(F.transform("scores", lambda s: F.struct((s["c"] + s["w"]).alias("total"), s["lang"].alias("lang"), s["c"].alias("c"), s["w"].alias("w"), s["m"].alias("m"))))
    scored = scored.withColumn("best", best)
    far = (F.col("word_chars") >= MIN_CHARS) & (F.col("best.c") > MOST_CLASS_DISTANCE)
    odd = (F.col("n_common") >= MIN_COMMON) & (F.col("best.w") > MOST_WORD_DISTANCE)
    rare = (F.col("n_words") >= MIN_WORDS) & (F.col("n_common") < LEAST_COMMON * F.col("best.m") * F.col("n_tokens"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~F.coalesce(far | odd | rare, F.lit(False))).alias("kept"),
        F.round("best.c", 6).alias("class_distance"), F.round("best.w", 6).alias("word_distance"), F.col("best.lang").alias("like_lang"),
    )


def digest(judged: DataFrame) -> DataFrame:
    return judged
