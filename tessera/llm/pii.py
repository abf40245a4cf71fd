"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Regular expressions propose spans, which may overlap; features of their format and of the words
around them go into gradient-boosted trees; a span is taken if its score reaches its kind's
threshold.  Spans of the base kinds that pass their checks (octets, Luhn, number of digits) are
always taken.  All work on the corpus is DataFrame operations: the trees become one SQL expression.

There are no labels of personal data, so the trees learn from `SAMPLE` short texts made here, with
personal data and look-alikes (versions, measures, order numbers, hashes) in known places; their
candidates and features come from the same DataFrame operations.  Thresholds are set on as many
other texts, whose formats and cue words the trees have not seen: for each kind the lowest one whose
precision is at least 0.98.  A span within one of the base kinds adds nothing and is left out.

Rows are told apart by a generated key, so repeated rows or ids each get their own result.  Positions
come from running sums of the lengths of matches and of the text between them.  No expression goes
back over what it has read more than once, so very long runs cost no more than their length.

Defined results: a null or empty text has no spans; other columns are ignored (`redacted` keeps
them); an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

BASE_KINDS = ("email", "ip", "card", "phone")
#: Quantifiers are possessive and starts are tied to the beginning of a run, or to the last match's
#: end, wherever that changes no match; it keeps the search linear and the matcher's stack flat.
GENERATORS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])",
    "spelt_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,64}+(?:\.[A-Za-z0-9-]{1,64}+)++",
    # The base rule for phones runs on into numbers that follow; this one ends with the phone.
    "whole_phone": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
KINDS = tuple(GENERATORS)
POSSIBLE = r"[0-9@]|[(\[]at[)\]]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
HINTS = {
    "h_phone": "tel|phone|call|fax|mobile|whatsapp|ring",
    "h_card": "card|visa|credit|debit|payment|mastercard",
    "h_id": "ssn|social|security|passport|iban|account|bank",
    "h_mail": "mail|contact|write|reach",
    "h_tech": "version|release|build|page|order|isbn|part|serial|hash|ticket|invoice|item|row|ratio|size|sku|rev",
}
CONTEXT = 28
FEATURES = ("kind_id", "n_digits", "n_chars", "n_parts", "luhn", "octets", "joined_before", "joined_after", "leading", *HINTS)
SAMPLE = 3000


def digits() -> Column:
    return F.regexp_replace("value", "[^0-9]", "")


def candidates(docs: DataFrame, text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """A row per proposed span, with its row's key, kind, start, end, value, context and features; rows without any give one of nulls."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def proposed(k: int, kind: str) -> Column:
        regex = F.lit(GENERATORS[kind])
        found = F.regexp_extract_all("_text", regex, F.lit(0))
        between = F.split("_text", GENERATORS[kind], -1)
        rows = F.transform(
            F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b"), F.slice(between, F.lit(2), F.size(found)).alias("a")),
            lambda z, i: F.struct(F.lit(k).alias("kind_id"), i.alias("at"), F.length(z["b"]).alias("gap"), z["m"].alias("value"), F.right(z["b"], F.lit(CONTEXT)).alias("before"), F.substring(z["a"], 1, 1).alias("after")),
        )
        return F.when(F.col("_text").rlike(GENERATORS[kind]), rows)

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), (keep if keep is not None else F.lit(None)).alias("_kept"), text.alias("_text"))
    none = F.array().cast("array<struct<kind_id:int,at:int,gap:int,value:string,before:string,after:string>>")
    listed = rows.select("_row", "_kept", F.concat(*(F.coalesce(proposed(k, kind), none) for k, kind in enumerate(KINDS))).alias("_found"))
    spread = listed.select("_row", "_kept", F.posexplode_outer("_found").alias("_n", "_c"))
    # What is kept of a row travels with its first candidate only.
    flat = spread.select("_row", F.when(F.coalesce("_n", F.lit(0)) == 0, F.col("_kept")).alias("_kept"), "_c.*").repartition("_row")
    each = W.partitionBy("_row", "kind_id").orderBy("at")
    start = F.sum("gap").over(each.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum(F.length("value")).over(each.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = flat.withColumn("start", start).withColumn("end", F.col("start") + F.length("value"))
    value, near = F.col("value"), F.lower("before")
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    n = F.length(digits())
    placed = placed.withColumns(
        {
            "n_digits": n,
            "n_chars": F.length(value),
            "n_parts": F.size(F.split(value, r"[\x20().:-]+")),
            "luhn": flag(n.between(12, 19) & F.call_function("luhn_check", digits())),
            "octets": flag(value.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")),
            "joined_before": flag(F.col("before").rlike("[A-Za-z0-9_.:/#=-]$")),
            "joined_after": flag(F.col("after").rlike("[A-Za-z0-9_/%=]")),
            "leading": F.coalesce(F.ascii(digits()) - 48, F.lit(-1)),
        }
        | {name: flag(near.rlike(rf"(?<![a-z])(?:{words})(?:s|number|no|code|address|at|id)?[^a-z0-9]*(?:[a-z]{{1,6}}[^a-z0-9]*)?$")) for name, words in HINTS.items()}
    )
    kind = F.col("kind_id")
    base = F.when(kind == 0, True).when(kind == 1, F.col("octets") == 1).when(kind == 2, n.between(13, 19) & (F.col("luhn") == 1)).when(kind == 3, n.between(9, 15)).otherwise(False)
    return placed.withColumn("base", base)


# Training.


def sample_texts(size: int = SAMPLE, seed: int = 3, held: bool = False, cues: dict[str, list[str]] | None = None, around: Sequence[str] = ()) -> list[tuple[str, list[tuple[str | None, int, int]]]]:
    """Texts with the places of the value in each: its kind if it is personal data, None if it looks like it.

    The formats and cue words of texts to learn from and of those held back differ; cues may replace
    the latter, and values are put into the texts `around`, if there are any, instead of made filler.
    """
    r = random.Random(seed + held)
    filler = "the report was read by many and the result in our view of it is that all of them have more to say on this later".split()
    some = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))
    way = lambda learnt, other: (other if held else learnt)()
    words = lambda learnt, other: other if held else learnt

    def luhn(n: int) -> str:
        body = r.choice("3456") + some(n - 2)
        total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(int(c) for c in reversed(body)))
        return body + str(-total % 10)

    def grouped(digits: str, seps: list[str]) -> str:
        sep = r.choice(seps)
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    true = {
        "email": (lambda: f"{name()}.{some(2)}@{name()}.{r.choice(words(['com', 'org'], ['de', 'net']))}", words(["mail", "write to", ""], ["contact", "reach", ""])),
        "ip": (lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), words(["from", "host", ""], ["address", "client", ""])),
        "card": (lambda: grouped(luhn(r.choice(words([15, 16, 16], [16, 14]))), words(["", " "], ["", "-"])), words(["card", "visa", "", "payment"], ["credit card", "debit", ""])),
        "phone": (lambda: way(lambda: f"+{r.randint(1, 99)} ({some(3)}) {some(3)}-{some(4)}", lambda: f"+{r.randint(1, 99)} {some(3)} {some(3)} {some(4)}"), words(["tel", "phone", ""], ["call", "mobile", ""])),
        "local_phone": (lambda: way(lambda: f"({r.randint(200, 999)}) {some(3)}-{some(4)}" if r.random() < 0.5 else f"{r.randint(200, 999)}-{some(3)}-{some(4)}", lambda: f"{r.randint(200, 999)}.{some(3)}.{some(4)}"), words(["tel", "phone", "call"], ["fax", "mobile", "ring"])),
        "national_id": (lambda: f"{some(3)}-{some(2)}-{some(4)}", words(["ssn", "social security number"], ["social", "passport"])),
        "iban": (lambda: r.choice(words(["DE", "FR", "ES"], ["GB", "IT", "NL"])) + some(2) + some(words(18, 20)), words(["iban", "account"], ["bank account", "iban no"])),
        "spelt_email": (lambda: f"{name()}{words(' (at) ', ' [at] ')}{name()}.{r.choice(words(['com', 'org'], ['de', 'net']))}", words(["mail", ""], ["contact", ""])),
        # A number follows at once, which takes the base rule beyond what a phone may have.
        "whole_phone": (lambda: f"+{r.randint(1, 99)} ({some(3)}) {some(3)}-{some(4)}" if not held else f"+{r.randint(1, 99)}-{some(3)}-{some(3)}-{some(4)}", words(["tel", "phone", ""], ["call", "mobile", ""])),
    }
    false = [
        (lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 400)}.{r.randint(300, 9000)}", words(["version", "release"], ["build", "rev"])),
        (lambda: some(r.choice(words([10, 12, 13, 16], [11, 14, 18]))), words(["order", "serial", "item", ""], ["invoice", "part", ""])),
        (lambda: f"{some(3)} {some(3)} {some(4)}", words(["row", "size", ""], ["ratio", "page"])),
        (lambda: f"{some(3)}-{some(2)}-{some(4)}", words(["part", "order", ""], ["sku", "item"])),
        (lambda: f"{some(3)}-{some(3)}-{some(4)}", words(["part", "order", ""], ["sku", "ticket"])),
        (lambda: f"{r.choice(['AB', 'XK', 'PN'])}{some(2)}{name().upper()}{some(9)}", words(["part", "serial"], ["sku", "item"])),
        (lambda: "".join(r.choice("0123456789abcdef") for _ in range(words(40, 32))), words(["hash", ""], ["build", ""])),
        (lambda: f"{r.randint(1900, 2030)}-{some(2)}-{some(2)}", words(["on", "since"], ["page", "until"])),
        (lambda: f"+{some(1)} {some(2)} {some(2)}", words(["ratio", "row"], ["size"])),
        (lambda: some(r.randint(2, 5)), words(["page", "row", ""], ["in", "of"])),
    ]
    out = []
    for k in range(size):
        kind = r.choice([*true, *[None] * 9])
        make, known = true[kind] if kind else r.choice(false)
        value, cue = make(), r.choice((cues or {}).get(kind or "", known))
        if around:
            text = around[k % len(around)]
            at = r.choice([0, *(i + 1 for i, c in enumerate(text) if c in " \n")])
            before, rest = text[:at], text[at:]
        else:
            before, rest = "".join(w + " " for w in r.choices(filler, k=r.randint(0, 8))), " ".join(r.choices(filler, k=r.randint(0, 6)))
        head = before + (cue + r.choice([" ", ": ", " is "]) if cue else "")
        after = f" {some(3)}.{some(2)} " if kind == "whole_phone" else r.choice([" ", ". ", ", "])
        out.append((head + value + after + rest, [(kind, len(head), len(head) + len(value))]))
    return out


Node = tuple


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Node:
    """A regression tree on gradients: a leaf's value, or (feature, threshold, node up to it, node above)."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 16:
        return (leaf,)
    best, found = g.sum() ** 2 / (h.sum() + 1.0) + 1e-3, None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2 if len(values) <= 40 else np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 32))):
            left = x[:, f] <= cut
            if 8 <= left.sum() <= len(left) - 8:
                gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0)
                if gain > best:
                    best, found = gain, (f, float(cut), left)
    if found is None:
        return (leaf,)
    f, cut, left = found
    return f, cut, grow(x[left], g[left], h[left], depth - 1), grow(x[~left], g[~left], h[~left], depth - 1)


def value_of(node: Node, x: np.ndarray) -> np.ndarray:
    if len(node) == 1:
        return np.full(len(x), node[0])
    f, cut, low, high = node
    return np.where(x[:, f] <= cut, value_of(low, x), value_of(high, x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 30, rate: float = 0.4, depth: int = 3) -> list[Node]:
    score, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, p - y, p * (1 - p), depth)
        out.append(tree)
        score += rate * value_of(tree, x)
    return out


def sql_of(node: Node, rate: float) -> str:
    if len(node) == 1:
        return f"{rate * node[0]:.6f}D"
    f, cut, low, high = node
    return f"CASE WHEN {FEATURES[f]} <= {cut!r} THEN {sql_of(low, rate)} ELSE {sql_of(high, rate)} END"


@lru_cache(maxsize=4)
def _learnt(rows: tuple, rate: float = 0.4) -> tuple[str, tuple[float, ...]]:
    data = np.array(rows, dtype=np.float64)
    held, x, y = data[:, 0] > 0, data[:, 2:-1], data[:, -1]
    trees = boost(x[~held], y[~held], rate=rate)
    score = sum(rate * value_of(t, x[held]) for t in trees)
    cuts = []
    for k in range(len(KINDS)):
        mine = x[held][:, 0] == k
        s, t = score[mine], y[held][mine]
        good = [c for c in np.unique(s) if t[s >= c].mean() >= 0.98]
        cuts.append(float(min(good)) - 1e-3 if good else float("inf"))  # the expression rounds its numbers
    return " + ".join(f"({sql_of(t, rate)})" for t in trees), tuple(cuts)


def learn(spark: SparkSession, size: int = SAMPLE, seed: int = 3) -> tuple[str, tuple[float, ...]]:
    """The trees as a SQL expression over FEATURES, and a threshold for each kind."""
    made = [*sample_texts(size, seed), *sample_texts(size, seed, held=True)]
    known = {(i, a, b) for i, (_, values) in enumerate(made) for kind, a, b in values if kind}  # under whatever name
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "i long, text string")
    found = candidates(texts, keep=F.col("i")).where("kind_id is not null")
    # _kept is on a row's first candidate only; the others have it from their row.
    number = F.first("_kept", ignorenulls=True).over(W.partitionBy("_row").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = found.select(number.alias("i"), "start", "end", *FEATURES).collect()  # of the made texts only
    return _learnt(tuple(sorted((int(r["i"] >= size), r["i"], *(r[f] for f in FEATURES), int((r["i"], r["start"], r["end"]) in known)) for r in rows)))


def spans(docs: DataFrame, model: tuple[str, Sequence[float]], text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """Of each row, `kept` (the expression keep) and `spans`: array of (kind_id, start, end, base), sorted."""
    score, cuts = model
    rows = docs.where(F.coalesce(F.col(text_col).rlike(POSSIBLE), F.lit(False)))
    none = F.array().cast("array<struct<kind_id:int,start:long,end:long,base:boolean>>")
    plain = docs.where(~F.coalesce(F.col(text_col).rlike(POSSIBLE), F.lit(False))).select((keep if keep is not None else F.lit(None)).alias("kept"), none.alias("spans"))
    found = candidates(rows, text_col, keep).withColumn("score", F.expr(score))
    chosen = F.col("base") | F.coalesce(*(F.when(F.col("kind_id") == k, F.col("score") >= F.lit(c)) for k, c in enumerate(cuts)), F.lit(False))
    span = F.when(chosen, F.struct("kind_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "base"))
    taken = found.groupBy("_row").agg(F.first("_kept", ignorenulls=True).alias("kept"), F.array_sort(F.collect_list(span)).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    new = lambda s: s["base"] | ~F.exists("_base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    taken = taken.withColumn("_base", base).select("kept", F.filter("spans", new).cast("array<struct<kind_id:int,start:long,end:long,base:boolean>>").alias("spans"))
    return plain.unionByName(taken)


def redacted(docs: DataFrame, model: tuple[str, Sequence[float]], text_col: str = "text") -> DataFrame:
    """docs with `[KIND]` in place of every span taken; of overlapping spans the first names the joint one."""
    columns = docs.columns
    found = spans(docs, model, text_col, F.struct(*(F.col(f"`{c}`") for c in columns)))
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind_id"].alias("kind_id"))))
    merged = F.aggregate(
        by_start,
        F.array().cast("array<struct<start:long,end:long,kind_id:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"), F.element_at(acc, -1)["kind_id"].alias("kind_id")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col(f"kept.`{text_col}`")
    sub = lambda a, n: F.substring(text, a.cast("int"), n.cast("int"))
    parts = F.transform("_merged", lambda s, i: F.concat(sub(F.when(i > 0, F.element_at("_merged", F.greatest(i, F.lit(1)))["end"]).otherwise(0) + 1, s["start"] - F.when(i > 0, F.element_at("_merged", F.greatest(i, F.lit(1)))["end"]).otherwise(0)), F.element_at(tags, s["kind_id"] + 1)))
    rest = sub(F.element_at("_merged", -1)["end"] + 1, F.length(text) + 1)
    new = F.when(F.size("_merged") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)
    return found.withColumn("_merged", F.when(F.size("spans") > 0, merged).otherwise(F.array().cast("array<struct<start:long,end:long,kind_id:int>>"))).select(*(new.alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in columns))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"), learn(spark), keep=F.col("doc_id"))
    names = F.array(*(F.lit(k) for k in KINDS))
    line = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.element_at(names, s["kind_id"] + 1), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind_id"] == k))).cast("long")
    return found.select(F.col("kept").alias("doc_id"), *(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
