"""Secret scan with DataFrame functions only: fixed patterns plus sliding-window entropy.

Spans are (kind, start, end) in code points, end exclusive. Positions come from cutting the text at the matches: the
lengths of what lies between and of the matches add up to every start. Candidate strings are judged by the Shannon entropy of every window of ``WINDOW`` characters; the sum of c*log2(c) is carried from window to window
and changed by the character that enters and the one that leaves. Allow-listed shapes are never reported, and an entropy
span that lies within a span of a fixed pattern is not listed again; one that reaches beyond it is.

Defined cases: a null text counts as empty and has no spans; every row is judged by itself, whatever its doc_id; an
empty table gives an empty result; a very long text is scanned whole, and a candidate's cost grows with its length alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix

# fixed values: patterns of the base kinds, in the order in which kinds are listed
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Counts of a window that one number holds, bits of a count (a window has fewer than 32 characters), numbers needed.
PACKED, COUNT_BITS = 12, 5
WORDS = -(-(len(ALPHABET) + 1) // PACKED)
#: Character class -> least entropy in bits of its best window; without a digit a string must be as good as random.
ENTROPY = (("^[^0-9]+$", 4.0), ("^[0-9a-fA-F]+$", 2.9), ("^[A-Z0-9]+$", 3.3), ("", 3.6))
#: Shapes that look random and are no secrets: plain numbers, UUIDs, documentation samples, dated paths.
ALLOW = (r"^[0-9]+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(?i)example|sample|placeholder|xxxx", r"^[a-z/_-]+[0-9]{1,4}$", r"(^|/)[0-9]{4}/[0-9]{2}/[0-9]{2}(/|$)")

_SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def located(text: Column, pattern: str, kind: str, order: int) -> Column:
    """All non-overlapping matches of ``pattern`` in ``text``, leftmost first, as an array of spans."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), F.transform(found, lambda m: F.length(m)).alias("len")),
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda st, x: F.struct((st["pos"] + x["gap"] + x["len"]).alias("pos"), F.concat(st["out"], F.array(F.struct((st["pos"] + x["gap"]).alias("start"), (st["pos"] + x["gap"] + x["len"]).alias("end")))).alias("out")),
        lambda st: st["out"],
    )
    return F.transform(start, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _when(cheap: Column, spans: Column) -> Column:
    return F.when(cheap, spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """Spans of kinds assign, access and hex; the cheap tests in front keep the patterns off most texts."""
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LEAST)
    assign = F.transform(
        F.filter(F.arrays_zip(located(text, ASSIGN, "assign", 0).alias("span"), long_enough.alias("keep")), lambda x: x["keep"]), lambda x: x["span"]
    )
    sign = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return (
        _when(sign & text.rlike(ASSIGN), assign),
        _when(F.contains(text, F.lit("AKIA")), located(text, ACCESS, "access", 1)),
        _when(text.rlike(HEX), located(text, HEX, "hex", 2)),
    )


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of any ``window`` characters in a row; 0 for shorter strings.

    The counts of a window are packed into a few numbers, ``PACKED`` to each; a step changes the two counts of the
    characters that enter and leave, and the sum of c*log2(c) by them.
    """
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.regexp_extract_all(candidate, F.lit("(?s)."), F.lit(0)), lambda ch: F.instr(F.lit(ALPHABET), ch))
    leaving = F.slice(F.concat(F.array_repeat(F.lit(-1), F.lit(window)), codes), F.lit(1), F.size(codes))
    moves = F.zip_with(codes, leaving, lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
    words = [F.lit(0).cast("long").alias(f"w{i}") for i in range(WORDS)]
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"), *words)
    return F.aggregate(moves, start, lambda st, x: _step(st, x["enters"], x["leaves"], table, window), lambda st: st["best"])


def _count(st: Column, code: Column) -> Column:
    """How often the window holds ``code``."""
    word = st["w0"]
    for i in range(1, WORDS):
        word = F.when(code >= i * PACKED, st[f"w{i}"]).otherwise(word)
    return F.call_function("shiftright", word, code % PACKED * COUNT_BITS).bitwiseAND(F.lit((1 << COUNT_BITS) - 1).cast("long")).cast("int")


def _step(st: Column, enters: Column, leaves: Column, table: Column, window: int) -> Column:
    full = leaves >= 0
    gone = F.when(full, _count(st, leaves)).otherwise(0)
    had = _count(st, enters) - F.when(leaves == enters, 1).otherwise(0)
    s = st["s"] - F.when(full, F.get(table, gone) - F.get(table, gone - 1)).otherwise(0.0) + F.get(table, had + 1) - F.get(table, had)
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), code % PACKED * COUNT_BITS)
    inside = lambda code, i: (code >= i * PACKED) & (code < (i + 1) * PACKED)
    words = [(st[f"w{i}"] + F.when(inside(enters, i), one(enters)).otherwise(0) - F.when(inside(leaves, i), one(leaves)).otherwise(0)).alias(f"w{i}") for i in range(WORDS)]
    best = F.when(st["n"] + 1 >= window, F.greatest(st["best"], F.lit(math.log2(window)) - s / F.lit(float(window)))).otherwise(st["best"])
    return F.struct((st["n"] + 1).alias("n"), s.alias("s"), best.alias("best"), *words)


def suspicious(candidate: Column) -> Column:
    """Whether a candidate is outside the allow-list and random enough for its character class."""
    allowed = F.lit(False)
    for shape in ALLOW:
        allowed = allowed | candidate.rlike(shape)
    least = F.lit(ENTROPY[-1][1])
    for shape, bits in reversed(ENTROPY[:-1]):
        least = F.when(candidate.rlike(shape), F.lit(bits)).otherwise(least)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(candidate) >= least)


def entropy_spans(text: Column) -> Column:
    marks = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), suspicious)
    spans = F.filter(F.arrays_zip(located(text, CANDIDATE, "entropy", 3).alias("span"), marks.alias("keep")), lambda x: x["keep"])
    return _when(text.rlike(CANDIDATE), F.transform(spans, lambda x: x["span"]))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with <prefix>base_spans, spans (arrays of start, ord, end, kind), n_assign, n_access, n_hex added."""
    t, n = free_prefix(docs, "_scan_"), prefix
    text = F.coalesce(F.col("text"), F.lit(""))
    a, c, h = base_spans(text)
    df = docs.withColumns({f"{t}assign": a, f"{t}access": c, f"{t}hex": h, f"{t}entropy": entropy_spans(text)})
    df = df.withColumn(f"{n}base_spans", F.array_sort(F.concat(f"{t}assign", f"{t}access", f"{t}hex")))
    extra = F.filter(f"{t}entropy", lambda e: ~F.exists(f"{n}base_spans", lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"])))
    df = df.withColumn(f"{n}spans", F.array_sort(F.concat(f"{n}base_spans", extra)))
    df = df.withColumns({f"{n}n_{k}": F.size(f"{t}{k}").cast("long") for k in ("assign", "access", "hex")})
    return df.drop(*[f"{t}{k}" for k in ("assign", "access", "hex", "entropy")])


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined)."""
    s = scan_secrets(docs.select("doc_id", "text"))
    return s.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_digest(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span masked in ``text``; ``n_chars``, if there is one, follows. No row goes, no column is added."""
    p = free_prefix(docs, "_found_")
    df = scan_secrets(docs, p)
    hit = F.size(f"{p}spans") > 0
    df = df.withColumn("text", F.when(hit, redact(F.col("text"), F.col(f"{p}spans"), mask)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mask``; overlapping spans give one mask."""
    st = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda st, s: F.struct(
            F.greatest(st["pos"], s["end"]).alias("pos"),
            F.when(s["start"] < st["pos"], st["out"]).otherwise(F.concat(st["out"], F.substring(text, st["pos"] + 1, s["start"] - st["pos"]), F.lit(mask))).alias("out"),
        ),
    )
    return F.concat(st["out"], F.substring(text, st["pos"] + 1, F.length(text)))
