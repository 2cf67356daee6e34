"""Secret scans with DataFrame functions alone, each text inside its own row: nothing is shuffled.

Base kinds are patterns; their matches are leftmost and do not overlap within a kind, and matches that are too short
are dropped afterwards. The method adds ``entropy`` spans: candidate strings of letters, digits and ``+/_=-``, with a
window slid over each. The counts of the window's characters are kept from step to step; one character comes in, one
goes out, two counts change and with them the window's Shannon entropy. The highest one is held against the threshold
of the candidate's character class; a candidate without a letter or without a digit has none. Candidates that touch a base span and those on the allow-list are passed over.

Null and empty texts have no spans, an empty table gives no rows, repeated rows each keep their result. Places are code
points, ends exclusive; spans that begin together are listed by kind. A text is split at its matches and the pieces'
lengths are summed in order, in blocks, so that very long texts, candidates and lists of matches cost little more than
in proportion. Columns of the table may have any names; ``scan`` looks only at the two it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_=-]+"
KINDS = ("assign", "access", "hex", "entropy")
LEAST = {"assign": 12, "access": 18, "hex": 16, "entropy": 20}
#: Whole candidates that are no secrets: words, names and short numbers joined by marks, as in paths,
#: URLs and slugs; filler of one character; alphabets in order; documented samples, which say so at one end.
ALLOWED = (
    r"^/{0,2}([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})([-_/+=]+([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8}))*[-_/+=]*$"
    r"|(.)\4{9}|(?i:abcdefghij|0123456789)|^(?i:your|my|example|sample|dummy|placeholder|changeme)[-_]|EXAMPLE(KEY)?$"
)
#: Fixed value: what stands before the content of a data URL.
DATA_URL = "base64,"
#: Characters of a window, and bits that its entropy must reach, by class. One in a thousand random keys
#: of 20 characters lies below 2.73 (hex), 3.45 (letters and digits) and 3.48 (base64); of longer ones next to none.
WINDOW = 20
BITS = {"hex": 2.7, "alnum": 3.4, "base64": 3.4}
#: Characters that a candidate may have lie within so many code points from ``+``; counts of at most WINDOW are kept
#: twelve to a number, five bits each.
FIRST, WORDS, PACKED, BITS_EACH = 43, 7, 12, 5
#: Entries of a running fold that are handled together.
FOLD = 128


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _blocks(items: Column, size: int = FOLD) -> Column:
    return _let(items, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / size).cast("int") - 1, F.lit(0))), lambda k: F.slice(x, k * size + 1, F.lit(size))))


def running(items: Column, combine, start: Column) -> Column:
    """Fold of each array<long> entry with all before it. Blocks keep the cost of growing arrays in proportion."""
    none = F.array().cast("array<bigint>")

    def block(state: Column, part: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            return _let(combine(s["last"], x), lambda y: F.struct(y.alias("last"), F.concat(s["out"], F.array(y)).alias("out")))

        inner = F.aggregate(part, F.struct(state["last"].alias("last"), none.alias("out")), step)
        return _let(inner, lambda r: F.struct(r["last"].alias("last"), F.concat(state["out"], F.array(r["out"])).alias("out")))

    zero = F.struct(start.cast("bigint").alias("last"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.aggregate(_blocks(items), zero, block, lambda s: F.flatten(s["out"]))


def _pattern(kind: str) -> str:
    # Runs of one class are maximal, so asking for the least length at once finds the runs that are long enough.
    return {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}", "entropy": r"[A-Za-z0-9+/_=-]{20,}"}[kind]


def _present(kind: str, text: Column) -> Column:
    """A cheap test that holds wherever the pattern matches."""
    if kind == "assign":
        return text.rlike(r"[:=]") & text.rlike(r"(?i:password|passwd|secret|token|api_?key)")
    if kind == "access":
        return F.contains(text, F.lit("AKIA"))
    if kind == "hex":
        return text.rlike(r"[0-9a-f]{16}")
    return text.rlike(r"[A-Za-z0-9+/_=-]{20}")


def class_of(s: Column) -> Column:
    """hex, alnum (letters and digits) or base64; null where letters or digits are missing."""
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    return F.when(~mixed, F.lit(None)).when(s.rlike(r"^[0-9a-fA-F]+$"), "hex").when(s.rlike(r"^[A-Za-z0-9]+$"), "alnum").otherwise("base64")


def _weight(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count)).otherwise(0.0)


def highest_entropy(s: Column, size: int = WINDOW) -> Column:
    """Highest Shannon entropy (bits) of the windows of ``size`` (at most 31) characters of a candidate; of the whole
    string if it is shorter.

    total = sum of c * log2(c) over the counts c of a window's characters; entropy = log2(n) - total / n. A step adds
    one to the count of the character that comes in and takes one from that of the character that goes out. Codes are
    taken from an array that is made once, so the cost is in proportion to the length.
    """
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)

    def bump(counts: Column, code: Column, by: int) -> Column:
        unit = F.call_function("shiftleft", F.lit(by).cast("bigint"), (code % PACKED) * BITS_EACH)
        return F.transform(counts, lambda x, k: F.when(k == F.floor(code / PACKED), x + unit).otherwise(x))

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, F.floor(code / PACKED).cast("int")), (code % PACKED) * BITS_EACH).bitwiseAND(F.lit(31)).cast("double")

    def step(state: Column, x: Column) -> Column:
        leaves = x["out"] >= 0
        less = F.when(leaves, bump(state["counts"], x["out"], -1)).otherwise(state["counts"])

        def entered(counts: Column) -> Column:
            left = F.when(leaves, _let(count(counts, x["out"]), lambda c: _weight(c + 1) - _weight(c))).otherwise(0.0)
            added = _let(count(counts, x["in"]), lambda c: _weight(c + 1) - _weight(c))
            n = F.least(state["n"] + 1, F.lit(size))
            return _let(
                state["total"] - left + added,
                lambda total: F.struct(
                    bump(counts, x["in"], 1).alias("counts"),
                    n.alias("n"),
                    total.alias("total"),
                    # Windows that are not full yet count only as the whole of a short string, at the end.
                    F.when(n == size, F.greatest(state["best"], F.log2(n.cast("double")) - total / n)).otherwise(state["best"]).alias("best"),
                ),
            )

        return _let(less, entered)

    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), WORDS).alias("counts"), F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    short = lambda st: F.when(st["n"] == size, st["best"]).when(st["n"] > 0, F.log2(st["n"].cast("double")) - st["total"] / st["n"]).otherwise(0.0)
    pairs = _let(codes, lambda c: F.arrays_zip(c.alias("in"), F.slice(F.concat(F.array_repeat(F.lit(-1), size), c), F.lit(1), F.size(c)).alias("out")))
    # arrays_zip names its fields by place inside a lambda function
    named = F.transform(pairs, lambda p: p.cast("struct<in:int,out:int>"))
    return F.aggregate(named, start, step, short)


_SPAN = "array<struct<start:bigint,order:int,end:bigint>>"


def _matches(text: Column, kind: str) -> Column:
    """array<struct<gap, hit, core, end>> of a kind's matches that are long enough; empty where there are none."""
    pattern = _pattern(kind)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cores = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if kind == "assign" else 0))

    def placed(found: Column) -> Column:
        ends = running(F.transform(F.arrays_zip(F.slice(found["gaps"], F.lit(1), F.size(found["hits"])), found["hits"]).cast("array<struct<a:string,b:string>>"), lambda p: (F.length(p["a"]) + F.length(p["b"])).cast("bigint")), lambda a, b: a + b, F.lit(0))
        zipped = F.arrays_zip(F.slice(found["gaps"], F.lit(1), F.size(found["hits"])), found["hits"], found["cores"], ends)
        return F.filter(zipped.cast("array<struct<gap:string,hit:string,core:string,end:bigint>>"), lambda m: F.length(m["core"]) >= LEAST[kind])

    found = _let(F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits"), cores.alias("cores")), lambda f: F.when(F.size(f["hits"]) > 0, placed(f)))
    empty = F.array().cast("array<struct<gap:string,hit:string,core:string,end:bigint>>")
    return F.when(_present(kind, text), F.coalesce(found, empty)).otherwise(empty)


def _is_secret(m: Column) -> Column:
    kind = class_of(m["hit"])
    bits = F.coalesce(*[F.when(kind == c, F.lit(b)) for c, b in BITS.items()])
    return F.coalesce(~m["hit"].rlike(ALLOWED) & ~F.endswith(m["gap"], F.lit(DATA_URL)) & kind.isNotNull() & (highest_entropy(m["hit"]) >= bits), F.lit(False))


def _spans(matches: Column, order: int) -> Column:
    return F.transform(matches, lambda m: F.struct((m["end"] - F.length(m["hit"])).cast("bigint").alias("start"), F.lit(order).alias("order"), m["end"].alias("end"))).cast(_SPAN)


def _clear_of(candidates: Column, base: Column) -> Column:
    """The candidates (array of spans) that no base span overlaps: the latest base end before, the first base start after."""
    far = 1 << 62

    def judged(spans: Column) -> Column:
        is_base = lambda x: x["order"] != len(KINDS) - 1
        before = running(F.transform(spans, lambda x: F.when(is_base(x), x["end"]).otherwise(F.lit(0)).cast("bigint")), lambda a, b: F.greatest(a, b), F.lit(0))
        after = F.reverse(running(F.reverse(F.transform(spans, lambda x: F.when(is_base(x), x["start"]).otherwise(F.lit(far)).cast("bigint"))), lambda a, b: F.least(a, b), F.lit(far)))
        zipped = F.arrays_zip(spans, before, after).cast(f"array<struct<span:{_SPAN[6:-1]},before:bigint,after:bigint>>")
        free = F.filter(zipped, lambda z: (z["span"]["order"] == len(KINDS) - 1) & (z["before"] <= z["span"]["start"]) & (z["after"] >= z["span"]["end"]))
        return F.transform(free, lambda z: z["span"])

    return F.when(F.size(candidates) > 0, _let(F.array_sort(F.concat(base, candidates)), judged)).otherwise(candidates)


def with_spans(docs: DataFrame, text_col: str = "text", base_name: str = "base_spans", name: str = "all_spans") -> DataFrame:
    """``docs`` with two columns of spans (start, order of the kind in ``KINDS``, end) by start and order: base kinds, all."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.array_sort(F.concat(*[_spans(_matches(text, k), i) for i, k in enumerate(KINDS[:-1])]))
    found = docs.withColumn(base_name, base)
    strong = _spans(F.filter(_matches(text, "entropy"), _is_secret), len(KINDS) - 1)
    both = _let(strong, lambda c: F.array_sort(F.concat(F.col(base_name), _clear_of(c, F.col(base_name)))))
    return found.withColumn(name, both)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["order"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, n_entropy, base, spans) of every row; base and spans are ``kind:start:end``
    by start, then kind as listed, comma-joined."""
    lean = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = with_spans(lean)

    def number(order: int) -> Column:
        return F.size(F.filter("all_spans", lambda x: x["order"] == order)).cast("long")

    return found.select(
        F.col("id").alias(id_col),
        *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        _listed(F.col("base_spans")).alias("base"),
        _listed(F.col("all_spans")).alias("spans"),
    )


def _masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with the union of the spans (sorted by start) replaced; pieces are cut from blocks of it, so that many
    cuts of a long text don't each walk it from its start."""

    def cut(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(-1))

        def runs(r: Column) -> Column:
            ahead = F.concat(F.array(F.lit(-1).cast("bigint")), r)
            rows = F.arrays_zip(s, r, F.slice(ahead, F.lit(1), F.size(r)), F.slice(F.concat(F.transform(s, lambda x: x["start"]), F.array(F.lit(1 << 62))), F.lit(2), F.size(r)))
            named = rows.cast(f"array<struct<span:{_SPAN[6:-1]},reach:bigint,ahead:bigint,next:bigint>>")
            return _let(
                named,
                lambda n: F.struct(
                    F.transform(F.filter(n, lambda x: x["ahead"] < x["span"]["start"]), lambda x: x["span"]["start"]).alias("starts"),
                    F.transform(F.filter(n, lambda x: x["reach"] < x["next"]), lambda x: x["reach"]).alias("ends"),
                ),
            )

        def pieces(c: Column) -> Column:
            gaps = F.arrays_zip(F.concat(F.array(F.lit(0).cast("bigint")), c["ends"]), F.concat(c["starts"], F.array(F.length(text).cast("bigint"))))

            def block(part: Column) -> Column:
                at = F.get(part, 0)["from"]
                whole = F.substr(text, (at + 1).cast("int"), (F.element_at(part, -1)["to"] - at).cast("int"))
                return _let(whole, lambda w: F.transform(part, lambda g: F.substr(w, (g["from"] - at + 1).cast("int"), (g["to"] - g["from"]).cast("int"))))

            return F.array_join(F.flatten(F.transform(_blocks(gaps.cast("array<struct<from:bigint,to:bigint>>")), block)), mark)

        return _let(_let(reach, runs), pieces)

    return F.when(F.size(spans) > 0, _let(spans, cut)).otherwise(text)


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of every kind replaced by ``mark``; spans that overlap or touch become one. All columns
    stay, null texts stay null."""
    taken = {c.lower() for c in docs.columns}
    base, name = (next(n for n in (f"{label}{i or ''}" for i in range(len(taken) + 1)) if n not in taken) for label in ("base_spans", "all_spans"))
    found = with_spans(docs, text_col, base, name)
    return found.withColumn(text_col, F.when(F.col(text_col).isNotNull(), _masked(F.col(text_col), F.col(name), mark))).select(*docs.columns)
