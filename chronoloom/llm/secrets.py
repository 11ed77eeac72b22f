r"""Secret scan by a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: what every match must contain. The index lists, for every
trigram that some rule asks for, the rows whose lower-cased text contains it; postings of a row meet in one bit set, and a rule's
candidates are the rows whose bits satisfy its query. Only candidates are searched with the expression itself. Rules without mandatory
trigrams, such as a run of hexadecimal digits, are searched in all texts.

Every expression repeats only classes of characters, which Java matches in a loop, and no two of its places where a match can begin read
the same long run of characters, so that time grows with the length of a text and the stack not at all. The places of matches are running
sums over the lengths of the pieces between them, taken by a window over a row's matches; no array grows by one at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import fresh, materialise, meet, quoted, require, row_key, with_key


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: characters that the group must have; shorter matches are dropped after the search."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which kinds at one start are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Public formats of tokens and keys. The limits of 20 and 256 characters belong to the rule of logins in URLs.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,20}://[^\x20\x09-\x0D/:@]{1,256}:[^\x20\x09-\x0D/:@]{1,256}@"),
)
RULES = BASE + MORE

#: A query is True (anything), a trigram, or ("and" | "or", queries).
_MOST_STRINGS = 32


def _and(*queries):
    parts = []
    for q in queries:
        for x in q[1] if isinstance(q, tuple) and q[0] == "and" else [q]:
            if x is not True and x not in parts:
                parts.append(x)
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(*queries):
    if any(q is True for q in queries):
        return True
    needs = {q: set(q[1]) if isinstance(q, tuple) and q[0] == "and" else {q} for q in queries}
    parts = [q for q in needs if not any(needs[o] < needs[q] for o in needs)]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _trigrams(strings: set[str]):
    return _or(*(_and(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings))) if strings else True


def trigram_query(pattern: str):
    """What the lower-cased text around any match must contain. Sets of literal strings are carried along as far as they stay small."""

    def strings(op, arg) -> set[str] | None:
        if op is sre.LITERAL:
            return {chr(arg).lower()} if len(chr(arg).lower()) == 1 and arg < 128 else None
        if op is sre.IN:
            chars: set[str] = set()
            for kind, x in arg:
                if kind is sre.LITERAL and x < 128:
                    chars.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] < 128 and x[1] - x[0] < 8:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= 8 else None
        return None

    def walk(items) -> tuple[set[str] | None, object]:
        """The strings that the items can be, or None if too many; and the query."""
        run: set[str] | None = {""}
        whole, query = True, True
        for op, arg in items:
            own, sub = strings(op, arg), True
            if op is sre.SUBPATTERN:
                own, sub = walk(arg[3])
            elif op is sre.BRANCH:
                branches = [walk(b) for b in arg[1]]
                own = set().union(*(b[0] for b in branches)) if all(b[0] is not None for b in branches) else None
                sub = _or(*(_and(b[1], _trigrams(b[0]) if b[0] is not None else True) for b in branches))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, body = arg
                inner, inner_query = walk(body)
                own = {"", *inner} if (low, high) == (0, 1) and inner is not None else inner if (low, high) == (1, 1) else None
                sub = inner_query if low and own is None else True
                if low and own is None and inner is not None and len(inner) * len(run) <= _MOST_STRINGS:
                    run = {a + b for a in run for b in inner}  # the first of several
            if own is not None and len(own) * len(run) <= _MOST_STRINGS:
                run = {a + b for a in run for b in own}
            else:
                query, whole = _and(query, _trigrams(run), sub, _trigrams(own) if own is not None else True), False
                run = {""}
        return (run, query) if whole else (None, _and(query, _trigrams(run)))

    found, query = walk(_parser.parse(pattern.replace("(?i:", "(?:")))
    return _and(query, _trigrams(found) if found is not None else True)


def mentioned(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(mentioned, query[1]))


def satisfied(query, bits: dict[str, int], column: str) -> Column:
    """Whether a row's bit set satisfies a query."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.col(column)[bits[query] // 62].bitwiseAND(F.lit(1 << bits[query] % 62)) != 0
    parts = [satisfied(q, bits, column) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: trigram number and row key (doc_id, h), for every trigram asked for and each row whose lower-cased text contains it."""
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text"))["h"].alias("h"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams))))
    return rows.select("doc_id", "h", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, h, can: rows that satisfy the query of a rule with mandatory trigrams, and a bit for each rule."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*map(mentioned, queries)))
    if not trigrams:
        return docs.select("doc_id", F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("can")).where("false")
    bits = {t: k for k, t in enumerate(trigrams)}
    sets = [F.expr(f"bit_or(case when trigram div 62 = {k} then shiftleft(1L, trigram % 62) else 0L end)").alias(f"b{k}") for k in range((len(trigrams) + 61) // 62)]
    met = postings(docs, trigrams).groupBy("doc_id", "h").agg(*sets).withColumn("bits", F.array(*(f"b{k}" for k in range(len(sets)))))
    can = F.lit(0).cast("long")
    for k, q in enumerate(queries):
        if q is not True:
            can = can.bitwiseOR(F.when(satisfied(q, bits, "bits"), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return met.select("doc_id", "h", can.alias("can")).where("can <> 0")


_PIECE = "struct<kind: int, i: int, gap: int, bgap: int, n: int, bn: int, tested: int>"


def pieces_of(rule: Rule, order: int) -> str:
    """SQL for the rule's matches in body: the lengths, in characters and bytes, of the piece before each match and of the match."""
    p = "r'" + rule.pattern.replace("'", r"\x27") + "'"
    zipped = f"arrays_zip(split(body, {p}, -1), regexp_extract_all(body, {p}, 0), regexp_extract_all(body, {p}, {rule.group}))"
    lengths = "length(x.`0`), octet_length(x.`0`), length(x.`1`), octet_length(x.`1`), length(x.`2`)"
    return f"filter(transform({zipped}, (x, i) -> cast(struct({order}, i, {lengths}) as {_PIECE})), x -> x.n is not null)"


def located(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, h, kind, start, stop, and bstart and bstop in bytes: the matches of each distinct row key, failing ones dropped."""
    found = materialise(candidates(docs, rules))
    rows, h = with_key(docs.select("doc_id", "text"))
    searched = meet(rows, h, found, "left", found.count()).select("doc_id", F.col(h).alias("h"), "can", F.coalesce("text", F.lit("")).alias("body"))
    parts = []
    for k, rule in enumerate(rules):
        p = "r'" + rule.pattern.replace("'", r"\x27") + "'"
        asked = f"body rlike {p}" if trigram_query(rule.pattern) is True else f"coalesce(can, 0) & {1 << k} <> 0 and body rlike {p}"
        parts.append(f"case when {asked} then {pieces_of(rule, k)} else cast(array() as array<{_PIECE}>) end")
    flat = searched.select("doc_id", "h", F.expr(f"explode(concat({', '.join(parts)}))").alias("m")).select("doc_id", "h", "m.*")
    # repeated rows have the same pieces
    once = flat.groupBy("doc_id", "h", "kind", "i").agg(*(F.first(c).alias(c) for c in ("gap", "bgap", "n", "bn", "tested")))
    so_far = Window.partitionBy("doc_id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = once.withColumn("stop", F.sum(F.col("gap") + F.col("n")).over(so_far)).withColumn("bstop", F.sum(F.col("bgap") + F.col("bn")).over(so_far))
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("kind") + 1)
    return placed.where(F.col("tested") >= least).select(
        "doc_id", "h", "kind", (F.col("stop") - F.col("n")).cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), (F.col("bstop") - F.col("bn")).cast("int").alias("bstart"), F.col("bstop").cast("int").alias("bstop")
    )


_SPANS = "array<struct<start: int, kind: int, stop: int>>"


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of docs (doc_id, text) with secrets: an array of (start, kind number in rules, stop) in code points, sorted.

    Of each kind the leftmost non-overlapping matches; kinds may overlap each other. A null text counts as empty: no secrets. Rows that
    share an id, or have none, are searched on their own; repeated rows each give a row with the same spans. Texts of any length and any
    number of matches are searched whole. An empty table gives an empty result. A column named secrets is replaced; others of any name stay.
    """
    require(docs, ["doc_id", "text"])
    docs = docs.drop("secrets")
    own = materialise(located(docs, rules).groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("secrets")))
    rows, h = with_key(docs)
    out = meet(rows, h, own, "left", own.agg(F.sum(F.size("secrets"))).first()[0] or 0)
    return out.select(*map(quoted, docs.columns), F.expr(f"coalesce(secrets, cast(array() as {_SPANS}))").alias("secrets"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with each stretch of secrets (overlapping ones together) in the text replaced by the mark; n_chars, if there, follows the text.

    No row and no column goes; rows are treated as ``find`` treats them. Texts without secrets stay as they are, null ones null.
    """
    require(docs, ["doc_id", "text"])
    order = Window.partitionBy("doc_id", "h").orderBy("bstart", "bstop")
    before = F.max("bstop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    met = located(docs, rules).withColumn("new", F.when(F.col("bstart") < before, 0).otherwise(1))
    met = met.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = met.groupBy("doc_id", "h", "stretch").agg(F.min("bstart").alias("a"), F.max("bstop").alias("z"))
    rows, h = with_key(docs)
    (cuts,) = fresh(rows, "cuts")
    own = materialise(merged.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias(cuts)))
    out = meet(rows, h, own, "left", own.agg(F.sum(F.size(cuts))).first()[0] or 0)
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["z"]))
    stops = F.concat(F.transform(cuts, lambda c: c["a"]), F.array(F.octet_length("text")))
    # the text's bytes are bound once, and pieces are cut from them by place
    rest = F.transform(F.array(F.col("text").cast("binary")), lambda body: F.array_join(F.zip_with(starts, stops, lambda a, z: F.substring(body, a + 1, z - a).cast("string")), mark))[0]
    some = F.col(cuts).isNotNull()
    changed = out.withColumn("text", F.when(some, rest).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(some, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*map(quoted, docs.columns))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    names = ", ".join(f"'{r.kind}'" for r in rules)
    written = f"array_join(transform({{}}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.stop)), ',')"
    base = f"filter(secrets, x -> x.kind < {len(BASE)})"
    counts = [f"cast(size(filter(secrets, x -> x.kind = {k})) as bigint) as n_{r.kind}" for k, r in enumerate(BASE)]
    return found.selectExpr("doc_id", *counts, f"sha2({written.format(base)}, 256) as base_sha256", f"{written.format('secrets')} as spans")


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """The same spans by Python's re, for tests."""
    out = []
    for k, rule in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, text or "") if len(m[rule.group]) >= rule.least]
    return sorted(out)
