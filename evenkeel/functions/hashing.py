"""A 32-bit string hash and consistent-hash rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the hash, and of the names of a server's points.
_PRIME, _BASIS = 16777619, 2166136261
_POINT = "{}&&VN{}"


def _signed(x: int) -> int:
    x &= 0xFFFFFFFF
    return x - (1 << 32) if x >> 31 else x


def fnv32(text: str, additive: bool = False) -> int:
    """FNV-1a style hash over UTF-16 units with final mixing, as a non-negative number; `additive` is the variant whose
    second step adds."""
    h = _signed(_BASIS)
    raw = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = _signed((h ^ (raw[i] | raw[i + 1] << 8)) * _PRIME)
    h = _signed(h + (h << 13))
    h = _signed(h + (h >> 7)) if additive else _signed(h ^ (h >> 7))
    h = _signed(h + (h << 3))
    h = _signed(h ^ (h >> 17))
    h = _signed(h + (h << 5))
    return abs(h)


def _wrapped(x: Column) -> Column:
    """The low 32 bits of a long, as a signed number."""
    return F.shiftright(F.shiftleft(x, 32), 32)


def fnv32_column(text: Column, additive: bool = False) -> Column:
    """fnv32 of a string column in built-in functions; null stays null."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    n = (F.length(units) / 4).cast("int")
    none = F.array().cast("array<bigint>")
    code = lambda i: F.conv(F.substr(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    codes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), code)).otherwise(none)
    mixed = F.aggregate(codes, F.lit(_signed(_BASIS)).cast("long"), lambda h, c: _wrapped(h.bitwiseXOR(c) * _PRIME))

    def finish(h):
        h = _wrapped(h + F.shiftleft(h, 13))
        h = _wrapped(h + F.shiftright(h, 7)) if additive else h.bitwiseXOR(F.shiftright(h, 7))
        return h

    def finish2(h):
        h = _wrapped(h + F.shiftleft(h, 3))
        return h.bitwiseXOR(F.shiftright(h, 17))

    step = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    out = step(step(mixed, finish), finish2)
    return F.when(text.isNotNull(), F.abs(step(out, lambda h: _wrapped(h + F.shiftleft(h, 5)))))


class Ring:
    """Servers on a ring, each at `replicas` points, or at one under its own name and the additive hash if that is 0."""

    def __init__(self, servers, replicas: int = 5):
        self.replicas, self.points = replicas, {}
        for s in servers:
            self.add(s)

    def _names(self, server: str) -> list[str]:
        return [_POINT.format(server, i) for i in range(self.replicas)] if self.replicas else [server]

    def hash(self, name: str) -> int:
        return fnv32(name, additive=not self.replicas)

    def add(self, server: str) -> None:
        for name in self._names(server):
            self.points[self.hash(name)] = server

    def remove(self, server: str) -> None:
        for name in self._names(server):
            if self.points.get(self.hash(name)) == server:
                del self.points[self.hash(name)]

    def lookup(self, key: str) -> str:
        """The server at the first point at or after the key's, round the ring."""
        if not self.points:
            raise LookupError("the ring is empty")
        h = self.hash(key)
        later = [p for p in self.points if p >= h]
        return self.points[min(later or self.points)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.points.items()), "point long, server string")


def ring_lookup(keys: DataFrame, ring: Ring, col: str) -> DataFrame:
    """Add the server of each key; the ring (servers times replicas) goes along as a constant array."""
    points = F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(s).alias("s")) for p, s in sorted(ring.points.items())])
    hashed = keys.select(col).distinct().withColumn("_h", fnv32_column(F.col(col).cast("string"), additive=not ring.replicas))
    later = F.get(F.filter(points, lambda x: x["p"] >= F.col("_h")), F.lit(0))
    return keys.join(hashed.withColumn("server", F.coalesce(later["s"], points[0]["s"])).drop("_h"), col, "left")
