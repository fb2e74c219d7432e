"""Messages delivered more than once: exact quotient tables over permuted identifiers.

An identifier of a fixed width (a stamped one, a UUID, hex or decimal digits) packs
without loss into two words. Invertible turns permute them, and they are split into a
quotient and a remainder, which is kept complete: equal form, quotient and remainder mean
equal identifiers, so there are no false matches. Any other text is its own remainder, in
a shard by its hash, and just as exact.

Every task first inserts its own identifiers into a hash table (so one that makes up a
third of all rows leaves a task as one entry, however often it came), its entries go to
the shard of their quotient, and the shard's table inserts each identifier once and
counts its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.session import kept

#: Bits of the quotient, which names the shard.
QUOTIENT = 16
#: Entries that a task's table holds before it is put out and begun anew.
MOST_HELD = 2_000_000
KEY = ("_q", "_r", "_s", "_f", "_t")
#: Forms of identifiers in lower case, and how each packs into (high, low).
STAMPED, UUID, HEX = r"^evt-[0-9]{13}-[0-9a-z]{5}$", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^[0-9a-f]{32}$"
DIGITS = r"^[0-9]{1,18}$"


def normal_id(raw: Column) -> Column:
    """Lower case, without surrounding white space; null if nothing is left."""
    trimmed = F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
    return F.when(trimmed != "", trimmed)


def _turn(word: Column, salt: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word, F.lit(salt)), 64 - bits) if bits < 64 else F.xxhash64(word, F.lit(salt))


def quotient_key(ident: Column) -> Column:
    """struct(_q quotient, _r and _s remainder, _f form, _t text): equal exactly where `ident` is equal.

    Stamped identifiers are 44 bits of digits and 26 of base 36, and their remainder is
    one word; the others are two words of 64 bits. One word is mixed with the other and
    the other with the one in turns, each turn invertible, which spreads runs of
    neighbouring values over all shards. _f is 1 (stamped), 2 (UUID), 3 (32 hex digits),
    100 + n (n digits) or 0 (any other text).
    """
    bare = F.replace(ident, F.lit("-"), F.lit(""))
    form = F.when(ident.rlike(STAMPED), 1).when(ident.rlike(UUID), 2).when(ident.rlike(HEX), 3).when(ident.rlike(DIGITS), F.length(ident) + 100).otherwise(0)
    word = lambda c: F.conv(c, 16, -10).cast("long")
    high = F.when(form == 1, F.substring(ident, 5, 13).cast("long")).when(form.isin(2, 3), word(F.substring(bare, 1, 16))).when(form > 100, F.lit(0).cast("long"))
    low = F.when(form == 1, F.conv(F.substring(ident, 19, 5), 36, 10).cast("long")).when(form.isin(2, 3), word(F.substring(bare, 17, 16))).when(form > 100, ident.try_cast("long"))
    stamped = form == 1
    # turns on two words: (h, l) -> (h, l ^ f(h)) -> (h ^ g(l), l)
    low1 = low.bitwiseXOR(F.when(stamped, _turn(high, 1, 26)).otherwise(_turn(high, 1, 64)))
    high1 = high.bitwiseXOR(F.when(stamped, _turn(low1, 2, 44)).otherwise(_turn(low1, 2, 64)))
    quotient = F.when(stamped, F.shiftrightunsigned(high1, 44 - QUOTIENT)).when(form > 0, F.shiftrightunsigned(high1, 64 - QUOTIENT)).otherwise(F.shiftrightunsigned(F.xxhash64(ident), 64 - QUOTIENT)).cast("int")
    short = F.shiftleft(high1.bitwiseAND((1 << (44 - QUOTIENT)) - 1), 26).bitwiseOR(low1)  # 28 + 26 bits: complete
    rest = F.when(stamped, short).otherwise(high1.bitwiseAND((1 << (64 - QUOTIENT)) - 1))
    second = F.when(~stamped, low1)
    return F.struct(quotient.alias("_q"), rest.alias("_r"), second.alias("_s"), form.cast("int").alias("_f"), F.when(form == 0, ident).alias("_t"))


def identifier(q: Column, r: Column, s: Column, f: Column, t: Column) -> Column:
    """The identifier of a key: the permutation turned back."""
    stamped = f == 1
    low1 = F.when(stamped, r.bitwiseAND((1 << 26) - 1)).otherwise(s)
    high1 = F.when(stamped, F.shiftleft(q.cast("long"), 44 - QUOTIENT).bitwiseOR(F.shiftrightunsigned(r, 26))).otherwise(F.shiftleft(q.cast("long"), 64 - QUOTIENT).bitwiseOR(r))
    high = high1.bitwiseXOR(F.when(stamped, _turn(low1, 2, 44)).otherwise(_turn(low1, 2, 64)))
    low = low1.bitwiseXOR(F.when(stamped, _turn(high, 1, 26)).otherwise(_turn(high, 1, 64)))
    stamp = F.concat(F.lit("evt-"), F.lpad(high.cast("string"), 13, "0"), F.lit("-"), F.lpad(F.lower(F.conv(low.cast("string"), 10, 36)), 5, "0"))
    hexed = F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))
    dashed = F.regexp_replace(hexed, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    return F.when(f == 0, t).when(stamped, stamp).when(f == 2, dashed).when(f == 3, hexed).otherwise(F.lpad(low.cast("string"), f - 100, F.lit("0")))


def counted(keys: DataFrame) -> DataFrame:
    """KEY and n of each distinct key: tables of the tasks first, then one of each quotient."""

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def table() -> pa.Table:
            t = pa.concat_tables(held).combine_chunks()
            return t.group_by(list(KEY), use_threads=False).aggregate([("n", "sum")]).rename_columns([*KEY, "n"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch.append_column("n", pa.array([1] * len(batch), pa.int64()))]))
            size += len(batch)
            if size >= 1_000_000:
                done = table()
                if len(done) >= MOST_HELD // 2:
                    yield from done.to_batches(100_000)
                    held, size = [], 0
                else:
                    held, size = [done], len(done)
        if held:
            yield from table().to_batches(100_000)

    entries = keys.select(*KEY).mapInArrow(insert, "_q int, _r long, _s long, _f int, _t string, n long")
    return entries.repartition("_q").groupBy(*KEY).agg(F.sum("n").alias("n"))  # a quotient is whole in its shard: no other shuffle


def repeated(df: DataFrame, id_column: str = "id") -> DataFrame:
    """(id, copies): each identifier that more than one row carries.

    Null, empty and blank identifiers aren't messages and give no row. An empty table
    gives an empty result; other columns aren't read.
    """
    ids = df.select(normal_id(F.col(id_column)).alias("_k")).where("_k is not null")
    several = counted(ids.select(quotient_key(F.col("_k")).alias("k")).select("k.*")).where("n > 1")
    return several.select(identifier(*[F.col(c) for c in KEY]).alias("id"), F.col("n").alias("copies"))


def one_copy(df: DataFrame, id_column: str = "id", order: tuple[str, ...] = ("received_at", "batch_id", "timestamp")) -> DataFrame:
    """Exactly one row of each message, and every row without an identifier.

    The kept copy is the first by `order` (null last); ties go to the smallest row by
    all its columns, so the result doesn't depend on the partitioning. Its identifier
    stays as that copy wrote it. Columns keep their names, whatever these are.

    Identifiers are counted first, from their column alone. Rows whose identifier doesn't
    repeat stay where they are read; only the others are reduced to one each, in every
    task before the shuffle. (The repeated identifiers are joined by Spark's choice, by
    broadcast only while they are small.)
    """
    names = df.columns
    inner = [f"c{i}" for i in range(len(names))]
    flat = df.toDF(*inner)
    ident = normal_id(F.col(inner[names.index(id_column)]))
    several = kept(repeated(df, id_column).select(F.col("id").alias("_several")))
    marked = flat.withColumn("_k", ident).join(several, F.col("_k") == F.col("_several"), "left")
    alone = marked.where("_several is null").select(*inner)
    by = []
    for n in order:
        if n in names:
            c = F.col(inner[names.index(n)])
            by += [c.isNull(), c]
    comparable = [F.to_json(F.struct(c)) if isinstance(flat.schema[c].dataType, (T.MapType, T.VariantType)) else F.col(c) for c in inner]
    rank = F.struct(*[x.alias(f"o{i}") for i, x in enumerate([*by, *comparable])])
    first = marked.where("_several is not null").groupBy("_k").agg(F.min_by(F.struct(*inner), rank).alias("row")).select("row.*")
    return alone.unionAll(first).toDF(*names)
