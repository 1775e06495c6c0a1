"""Scalar functions over ids, SIDs, texts, times and vectors, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boundaries of time gaps in seconds (fixed values).
GAPS = [0, 30, 120, 300, 900, 1800, 3600, 10800, 21600, 43200, 86400, 172800, 345600, 604800, 1209600]


def sid_parse(sid: Column) -> Column:
    return F.transform(F.split(sid, "_"), lambda x: x.cast("int"))


def sid_format(tokens: Column) -> Column:
    return F.array_join(tokens.cast("array<string>"), "_")


def sid_prefix(sid: Column, k: int) -> Column:
    return F.substring_index(sid, "_", k)


def match_depth(a: Column, b: Column) -> Column:
    """Leading equal tokens of two arrays."""
    step = lambda acc, same: F.struct((acc["on"] & same).alias("on"), (acc["n"] + F.when(acc["on"] & same, 1).otherwise(0)).alias("n"))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def token_overlap(a: Column, b: Column) -> Column:
    """Share of positions with equal tokens, of the first array's length."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda s: s)) / F.size(a)


def reject_difficulty(truth: Column, candidate: Column) -> Column:
    """easy, medium or hard by the depth of agreement; null if the candidate is the truth."""
    depth = match_depth(truth, candidate)
    return F.when(truth == candidate, None).when(depth == 0, "easy").when(depth == 1, "medium").otherwise("hard")


def time_bucket(delta: Column, side: str = "right") -> Column:
    """Bucket 0..15 of a gap in seconds. right: boundaries <= gap; left: boundaries < gap."""
    bounds = F.array(*[F.lit(g).cast("bigint") for g in GAPS])
    d = F.greatest(delta, F.lit(0).cast("bigint"))
    return F.size(F.filter(bounds, (lambda b: b <= d) if side == "right" else (lambda b: b < d)))


def freshness(age_hours: Column, tau: float = 24.0) -> Column:
    return F.exp(-F.greatest(age_hours, F.lit(0.0)) / tau)


def mixed_radix_encode(codes: Column, levels: list[int]) -> Column:
    """First digit lowest: the sum of code_i times the product of the levels before it."""
    out, basis = F.lit(0).cast("bigint"), 1
    for i, n in enumerate(levels):
        out = out + codes[i].cast("bigint") * F.lit(basis)
        basis *= n
    return out


def mixed_radix_decode(code: Column, levels: list[int]) -> Column:
    out, basis = [], 1
    for n in levels:
        out.append((F.floor(code / F.lit(basis)) % F.lit(n)).cast("int"))
        basis *= n
    return F.array(*out)


def fsq_quantize(z: Column, level: int) -> Column:
    """Code of one dimension: tanh to the level's range, rounded half to even, clamped."""
    half = level // 2
    scaled = F.tanh(z) * F.lit(float(half))
    code = F.rint(scaled) + half if level % 2 else F.rint(scaled - 0.5) + half
    return F.greatest(F.least(code, F.lit(float(level - 1))), F.lit(0.0)).cast("int")


def fsq_dequantize(code: Column, level: int) -> Column:
    half = level // 2
    return (code - F.lit(half) + F.lit(0 if level % 2 else 1)).cast("double")


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)), F.lit(eps))
    return F.transform(d, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def shard_of(key: Column, shards: int = 8) -> Column:
    """The sha256 of the key modulo a power of two up to 16."""
    return (F.conv(F.right(F.sha2(key, 256), F.lit(1)), 16, 10).cast("int") % shards).cast("int")


def hash64(text: Column) -> Column:
    """The first 64 bits of sha256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_feature(text: Column, dim: int) -> Column:
    """struct(index, sign) of a hashed feature."""
    h = hash64(text)
    return F.struct((h % F.lit(dim)).cast("int").alias("index"), F.when(F.floor(h / F.lit(256)) % 2 == 0, -1.0).otherwise(1.0).alias("sign"))


def tokenize(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def genre_tokens(genres: Column) -> Column:
    named = F.filter(F.split(genres, r"\|"), lambda g: (g != "") & (g != "(no genres listed)"))
    return F.transform(named, lambda g: F.concat(F.lit("genre:"), F.lower(g)))


def decade(title: Column) -> Column:
    year = F.regexp_extract(title, r"\((\d{4})\)", 1)
    return F.when(year != "", F.concat(F.lit("year:"), F.substring(year, 1, 3), F.lit("0s")))


def prompt_text(title: Column, genres: Column) -> Column:
    return F.concat(F.lit("Movie title: "), title, F.lit("\nGenres: "), F.array_join(F.split(genres, r"\|"), ", "))


def image_key(url: Column) -> Column:
    m = F.md5(url)
    return F.concat(F.substring(m, 1, 2), F.lit("/"), m, F.lit(".jpg"))


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def quality_status(value: Column, steps: list[float], lower_is_better: bool = True) -> Column:
    """excellent, good, acceptable, poor by three thresholds; unknown for null."""
    out = F.when(value.isNull(), "unknown")
    for name, s in zip(("excellent", "good", "acceptable"), steps):
        out = out.when(value <= s if lower_is_better else value >= s, name)
    return out.otherwise("poor")


def contains_run(context: Column, run: Column) -> Column:
    """Whether the tokens of ``run`` stand consecutively anywhere in ``context``."""
    n = F.size(context) - F.size(run)
    starts = F.when(n >= 0, F.sequence(F.lit(1), n + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda j: F.slice(context, j, F.size(run)) == run)


def pack_bits(codes: Column, bits: int, count: int) -> Column:
    """``count`` codes of ``bits`` bits each as one number, the first code lowest."""
    out = F.lit(0).cast("bigint")
    for i in range(count):
        out = out.bitwiseOR(F.shiftleft(codes[i].cast("bigint"), i * bits))
    return out


def unpack_bits(packed: Column, bits: int, count: int) -> Column:
    return F.array(*[F.shiftright(packed, i * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int") for i in range(count)])
