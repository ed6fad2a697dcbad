"""Secret scan: known forms by pattern, and unknown ones by sliding-window entropy.

DataFrame functions only.  Spans are code points, end exclusive.

Base spans are the matches of three patterns, leftmost and non-overlapping per kind;
their places come from splitting the text at the pattern and adding up lengths.

Entropy spans: a candidate is a whole run of 20 or more key characters holding digits
and letters; ``=`` ends it, so the name in ``name=value`` is no part of it.  A window of ``WINDOW``
characters slides over it; the counts of the two characters that enter and leave change
sum(c log2 c), from which Shannon entropy follows, and the counts of what is no lower-case or upper-case
hexadecimal digit and no decimal one, which give the class of the window.  Hexadecimal windows and others have
their own thresholds, and one of decimal digits alone never passes.  Where windows
pass, the run from the first to the last of them is a span of kind ``entropy``, unless the
candidate is on the allow-list (public identifiers, named examples) or the span lies in
a base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (pattern of all matches, group that is measured, shortest that counts). Fixed values.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
#: Bits per character that a window must reach, by its class.
HEX_BITS, OTHER_BITS = 3.0, 3.6
#: Candidates that are no secrets: UUIDs, dates and numbers with separators, words that name an example.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_-]*$",
    r"(?i)example|sample|placeholder|dummy|xxxx",
    r"^(sha256|sha1|md5)-",
)


def _pieces(text: Column, pattern: str, group: int, kind: str) -> Column:
    """array<struct<start, kind, end, size>> of all matches."""
    between = F.split(text, pattern, -1)
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    parts = F.arrays_zip(between.alias("b"), match.alias("m"), measured.alias("g"))
    none = F.array().cast("array<struct<start:int,kind:string,end:int,size:int,text:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def add(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["b"])
        end = begin + F.coalesce(F.length(part["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.length(part["g"]).alias("size"), part["m"].alias("text"))
        return F.struct(end.alias("at"), F.when(part["m"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(span))).alias("found"))

    return F.when(F.size(match) > 0, F.aggregate(parts, start, add)["found"]).otherwise(none)


def _long(found: Column, least: int) -> Column:
    return F.filter(found, lambda s: s["size"] >= least)


def _spans(column: Column) -> Column:
    return F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _entropy(candidate: Column, window: int = WINDOW) -> Column:
    """struct<lo, hi>: first window that passes and the end of the last, within a candidate; lo -1 if none."""
    # bound once, so that a step does not split the candidate again
    return F.transform(F.array(F.split(candidate, "")), lambda chars: _slide(chars, window))[0]


def _slide(chars: Column, window: int) -> Column:
    """``_entropy`` of a candidate's characters."""
    count = lambda run, x: F.size(F.filter(run, lambda c: c == x)).cast("double")
    weigh = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))
    # one character of each class counts as 1 where it is none of the class
    kinds = {"lower": "0123456789abcdef", "upper": "0123456789ABCDEF", "digit": "0123456789"}
    other = lambda x, k: F.when(F.instr(F.lit(kinds[k]), x) > 0, 0).otherwise(1)
    head = F.slice(chars, 1, window)
    whole = F.aggregate(F.array_distinct(head), F.lit(0.0), lambda s, x: s + weigh(count(head, x)))
    strangers = lambda k: F.aggregate(head, F.lit(0), lambda n, x: n + other(x, k))
    strange = {k: strangers(k) for k in kinds}

    def passing(s: Column, n: dict[str, Column]) -> Column:
        bits = F.log2(F.lit(float(window))) - s / F.lit(float(window)) + F.lit(1e-9)
        limit = F.when((n["lower"] == 0) | (n["upper"] == 0), F.lit(HEX_BITS)).otherwise(F.lit(OTHER_BITS))
        return (n["digit"] > 0) & (bits >= limit)

    first = F.when(passing(whole, strange), F.lit(0)).otherwise(F.lit(-1))
    start = F.struct(whole.alias("s"), first.alias("lo"), F.when(first == 0, F.lit(window)).otherwise(F.lit(-1)).alias("hi"), *[n.alias(k) for k, n in strange.items()])

    def slide(acc: Column, i: Column) -> Column:
        run = F.slice(chars, i - F.lit(window), window)
        entering, leaving = F.get(chars, i - 1), F.get(chars, i - F.lit(window) - 1)
        a, b = count(run, entering), count(run, leaving)
        moved = acc["s"] + weigh(a + 1) - weigh(a) + weigh(b - 1) - weigh(b)
        s = F.when(entering == leaving, acc["s"]).otherwise(moved)
        n = {k: acc[k] + other(entering, k) - other(leaving, k) for k in kinds}
        passes = passing(s, n)
        lo = F.when(passes & (acc["lo"] < 0), i - F.lit(window)).otherwise(acc["lo"])
        return F.struct(s.alias("s"), lo.alias("lo"), F.when(passes, i).otherwise(acc["hi"]).alias("hi"), *[c.alias(k) for k, c in n.items()])

    later = F.when(F.size(chars) > window, F.sequence(F.lit(window + 1), F.size(chars))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(later, start, slide)


def _unknown(text: Column, base: Column) -> Column:
    """Entropy spans of a text that no base span holds."""
    found = _pieces(text, CANDIDATE, 0, "entropy")
    likely = F.filter(found, lambda c: c["text"].rlike("[0-9]") & c["text"].rlike("[A-Za-z]") & ~_allowed(c["text"]))
    measured = F.transform(likely, lambda c: F.struct(c["start"].alias("start"), _entropy(c["text"]).alias("e")))
    spans = F.transform(
        F.filter(measured, lambda m: m["e"]["lo"] >= 0),
        lambda m: F.struct((m["start"] + m["e"]["lo"]).alias("start"), F.lit("entropy").alias("kind"), (m["start"] + m["e"]["hi"]).alias("end")),
    )
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))


def _allowed(candidate: Column) -> Column:
    verdict = F.lit(False)
    for pattern in ALLOWED:
        verdict = verdict | candidate.rlike(pattern)
    return verdict


def scan(docs: DataFrame, text: str = "text", base: str = "base_spans", every: str = "secret_spans") -> DataFrame:
    """``docs`` with columns base_spans and secret_spans: array<struct<start, kind, end>>.

    base_spans hold the pattern matches, secret_spans these and the entropy spans, by start
    and then by kind as listed (assign, access, hex, entropy).  A null text is empty
    and has none.  Every row is judged by its own text alone.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, [*BASE, "entropy"])), s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end"))
    matched = {k: _long(_pieces(t, p, g, k), n) for k, (p, g, n) in BASE.items()}
    out = docs.withColumns({f"__{k}": _spans(v) for k, v in matched.items()})
    out = out.withColumn(base, _spans(F.array_sort(F.transform(F.concat(*[F.col(f"__{k}") for k in BASE]), order))))
    out = out.drop(*[f"__{k}" for k in BASE])
    likely = F.when(t.rlike(CANDIDATE), _unknown(t, F.col(base))).otherwise(F.array().cast("array<struct<start:int,kind:string,end:int>>"))
    return out.withColumn(every, _spans(F.array_sort(F.transform(F.concat(base, likely), order))))


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of secret characters replaced by ``mark``; other texts stay as they are."""
    names = docs.columns
    scanned = scan(docs, text, "__base_spans", "__secret_spans")
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), none.alias("kept"))

    def cut(acc: Column, s: Column) -> Column:
        piece = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        overlap = s["start"] < acc["at"]
        kept = F.when(overlap, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(piece, F.lit(mark))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), kept.alias("kept"))

    done = F.aggregate("__secret_spans", start, cut)
    clean = F.concat(F.array_join(done["kept"], ""), F.substring(F.col(text), done["at"] + 1, F.length(text)))
    safe = F.when(F.size("__secret_spans") > 0, clean).otherwise(F.col(text))
    return scanned.withColumn(text, safe).select(*names)
