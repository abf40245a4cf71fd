"""Scalar functions as column expressions; all of them run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 32) - 1
#: Fixed values of 64-bit FNV-1a: offset basis and the prime 2^40 + 0x1b3.
FNV_BASIS = 0xCBF29CE484222325
FNV_LOW = 0x1B3


def natural_key(path: Column) -> Column:
    """A key whose byte order is natural order: each run of digits becomes its length and its digits without leading zeros."""
    tokens = F.regexp_extract_all(path, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def keyed(t: Column) -> Column:
        bare = F.regexp_replace(t, "^0+", "")
        return F.when(t.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(bare).cast("string"), 4, "0"), bare)).otherwise(t)

    return F.array_join(F.transform(tokens, keyed), "")


def parse_int(s: Column, signed: bool = True) -> Column:
    """An integer if the whole text is one, without plus sign or blanks; else null."""
    return F.when(s.rlike(r"^-?[0-9]+\z" if signed else r"^[0-9]+\z"), s.try_cast("int"))


def parse_positive(s: Column) -> Column:
    n = parse_int(s)
    return F.when(n > 0, n)


def parse_double(s: Column) -> Column:
    """A finite number if the whole text is one; else null."""
    n = F.when(s.rlike(r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), s.try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def parse_pair(s: Column) -> Column:
    """struct(a, b) of "a,b"; null for anything else."""
    shape = r"^-?[0-9]+,-?[0-9]+\z"
    pair = F.struct(F.substring_index(s, ",", 1).try_cast("int").alias("a"), F.substring_index(s, ",", -1).try_cast("int").alias("b"))
    return F.when(s.rlike(shape) & pair["a"].isNotNull() & pair["b"].isNotNull(), pair)


QUOTED = r'"((?:\\.|[^"\\])*)"'


def unquoted(s: Column) -> Column:
    r"""The text of a quoted token: \" and \\ are undone, other escapes stay as they are."""
    return F.regexp_replace(s, r'\\(["\\])', "$1")


def quoted(s: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(s, r'(["\\])', r"\\$1"), F.lit('"'))


def index_path(pattern: str, index: Column) -> Column:
    """%d becomes the index and %% a percent sign."""
    check_index_pattern(pattern)
    out, literal, k = [], "", 0
    while k < len(pattern):
        if pattern[k] == "%":
            if pattern[k + 1] == "d":
                out += [F.lit(literal), index.cast("string")]
                literal = ""
            else:
                literal += "%"
            k += 2
        else:
            literal += pattern[k]
            k += 1
    return F.concat(*out, F.lit(literal))


def check_index_pattern(pattern: str, atlases: int = 1) -> None:
    """Only %d and %% are allowed; several atlases need a %d."""
    k, places = 0, 0
    while (k := pattern.find("%", k)) >= 0:
        kind = pattern[k + 1 : k + 2]
        if kind not in ("d", "%"):
            raise ValueError(f"bad directive at {k} in {pattern!r}")
        places += kind == "d"
        k += 2
    if atlases > 1 and not places:
        raise ValueError(f"{atlases} atlases need a %d in {pattern!r}")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def stem(path: Column) -> Column:
    """The file name without its extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*\z", "")


def animation_base(name: Column) -> Column:
    return F.regexp_replace(name, r"[0-9_\-. ()]+\z", "")


def css_name(name: Column) -> Column:
    safe = F.regexp_replace(name, "[^A-Za-z0-9_-]", "-")
    return F.when(safe.rlike("^[0-9]"), F.concat(F.lit("_"), safe)).otherwise(safe)


def csv_field(s: Column) -> Column:
    return F.when(s.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


#: The five entities of XML.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def xml_text(s: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, s)


def next_power_of_two(v: Column) -> Column:
    """The least power of two that is at least v; 1 for anything below."""
    n = F.greatest(v.cast("long"), F.lit(1)) - 1
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.when(n == 0, 0).otherwise(F.length(F.bin(n))))


def scaled(v: Column, scale: float) -> Column:
    """A side after scaling: rounded half up, at least 1."""
    return F.greatest(F.lit(1), F.round(v * F.lit(scale)).cast("int"))


def fnv1a(s: Column) -> Column:
    """64-bit FNV-1a of a text's UTF-8 bytes, as a two's-complement long.

    The state is kept as two halves of 32 bits, so that no product overflows under ANSI rules: the
    prime is 2^40 + 0x1b3, and the shift by 40 moves the low half up by 8 bits into the high one.
    """
    code = F.hex(F.encode(s, "utf-8"))
    octets = F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(s) - 1, F.lit(0))), lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(FNV_BASIS >> 32).cast("long").alias("high"), F.lit(FNV_BASIS & MASK).cast("long").alias("low"))

    def step(h: Column, octet: Column) -> Column:
        low = h["low"].bitwiseXOR(octet)
        product = low * FNV_LOW
        high = h["high"] * FNV_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(MASK).alias("high"), product.bitwiseAND(MASK).alias("low"))

    empty = F.array().cast("array<bigint>")
    return F.aggregate(F.when(F.octet_length(s) > 0, octets).otherwise(empty), start, step, lambda h: F.shiftleft(h["high"], 32).bitwiseOR(h["low"]))


def hex16(v: Column) -> Column:
    return F.lower(F.lpad(F.hex(v), 16, "0"))


def unsigned(v: Column) -> Column:
    """Decimal digits of a long read as unsigned."""
    return F.conv(F.hex(v), 16, 10)


def difference_hash(luma: Column, width: int, height: int) -> Column:
    """64-bit difference hash of an image given as its row-major luma: bit 8r + c is set where cell (r, c) is darker than its right neighbour.

    Cells are sampled at the nearest pixel of a grid of 9 columns and 8 rows.
    """
    at = lambda row, col: luma[(row * (height - 1) // 7) * width + col * (width - 1) // 8]
    bits = [F.when(at(r, c) < at(r, c + 1), F.shiftleft(F.lit(1).cast("long"), 8 * r + c)).otherwise(F.lit(0).cast("long")) for r in range(8) for c in range(8)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def color_distance(a: Column, b: Column) -> Column:
    """Sum of the differences of red, green and blue of two struct(r, g, b)."""
    return sum((F.abs(a[c] - b[c]) for c in ("g", "b")), F.abs(a["r"] - b["r"]))


def content_size(w: Column, h: Column, rotated: Column) -> tuple[Column, Column]:
    return F.when(rotated, h).otherwise(w), F.when(rotated, w).otherwise(h)


def normal_path(path: Column) -> Column:
    """A path without empty and `.` parts and with `..` taken back where there is something to take back."""
    absolute = path.startswith("/")

    def step(acc: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != "..")
        stay = part.isin("", ".") | ((part == "..") & absolute & (F.size(acc) == 0))
        return F.when(stay, acc).when(back, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(part)))

    parts = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def beside(path: Column, other: Column) -> Column:
    """The normal path of `other` as it is said in the file `path`: from that file's folder, unless it is absolute."""
    folder = F.regexp_replace(path, r"[^/]*\z", "")
    return normal_path(F.when(other.startswith("/"), other).otherwise(F.concat(folder, other)))
