"""Hash, ratio, path and format functions of chunk records: built-in where Spark has them, Arrow UDFs elsewhere."""

from __future__ import annotations

import hmac
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

_M64 = (1 << 64) - 1
MURMUR3_SEED = 0xABCDEF
BLOOM_SEED = 0x9747B28C


_C1, _C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F


def _rotated(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _M64


def _murmur3_rest(h1: int, h2: int, data: bytes, length: int) -> bytes:
    """From the state after some 16-byte lanes: the lanes and bytes that are left, and the end."""

    def fin(k: int) -> int:
        k = ((k ^ (k >> 33)) * 0xFF51AFD7ED558CCD) & _M64
        k = ((k ^ (k >> 33)) * 0xC4CEB9FE1A85EC53) & _M64
        return k ^ (k >> 33)

    whole = len(data) // 16 * 16
    for at in range(0, whole, 16):
        k1 = int.from_bytes(data[at : at + 8], "little")
        k2 = int.from_bytes(data[at + 8 : at + 16], "little")
        h1 ^= _rotated(k1 * _C1 & _M64, 31) * _C2 & _M64
        h1 = ((_rotated(h1, 27) + h2) * 5 + 0x52DCE729) & _M64
        h2 ^= _rotated(k2 * _C2 & _M64, 33) * _C1 & _M64
        h2 = ((_rotated(h2, 31) + h1) * 5 + 0x38495AB5) & _M64
    tail = data[whole:]
    if len(tail) > 8:
        h2 ^= _rotated(int.from_bytes(tail[8:], "little") * _C2 & _M64, 33) * _C1 & _M64
    if tail:
        h1 ^= _rotated(int.from_bytes(tail[:8], "little") * _C1 & _M64, 31) * _C2 & _M64
    h1, h2 = h1 ^ length, h2 ^ length
    h1 = (h1 + h2) & _M64
    h2 = (h2 + h1) & _M64
    h1, h2 = fin(h1), fin(h2)
    h1 = (h1 + h2) & _M64
    return h1.to_bytes(8, "little") + ((h2 + h1) & _M64).to_bytes(8, "little")


def murmur3_x64_128(data: bytes, seed: int = MURMUR3_SEED) -> bytes:
    """The public 128-bit Murmur3 for 64-bit machines: both halves little-endian."""
    return _murmur3_rest(seed, seed, data, len(data))


def murmur3_halves(keys: list[bytes], seed: int = MURMUR3_SEED) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit halves of murmur3_x64_128 of each key; keys of one length up to 8 bytes are hashed side by side."""
    n = len(keys[0]) if keys else 0
    if not 0 < n <= 8 or any(len(k) != n for k in keys):
        both = np.array([np.frombuffer(murmur3_x64_128(k, seed), "<u8") for k in keys], np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]
    u = np.uint64

    def fin(k: np.ndarray) -> np.ndarray:
        k = (k ^ (k >> u(33))) * u(0xFF51AFD7ED558CCD)
        k = (k ^ (k >> u(33))) * u(0xC4CEB9FE1A85EC53)
        return k ^ (k >> u(33))

    wide = np.zeros((len(keys), 8), np.uint8)
    wide[:, :n] = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, n)
    k = wide.view("<u8")[:, 0] * u(_C1)
    h2 = np.full(len(keys), seed ^ n, u)
    h1 = (((k << u(31)) | (k >> u(33))) * u(_C2) ^ h2) + h2
    h2 = h2 + h1
    h1, h2 = fin(h1), fin(h2)
    h1 = h1 + h2
    return h1, h2 + h1


def _murmur2_rest(h: int, data: bytes) -> int:
    m, mask = 0x5BD1E995, 0xFFFFFFFF
    whole = len(data) // 4 * 4
    for at in range(0, whole, 4):
        k = int.from_bytes(data[at : at + 4], "little") * m & mask
        h = (h * m & mask) ^ ((k ^ (k >> 24)) * m & mask)
    if len(data) > whole:
        h = (h ^ int.from_bytes(data[whole:], "little")) * m & mask
    h = (h ^ (h >> 13)) * m & mask
    return h ^ (h >> 15)


def murmur2_32(data: bytes, seed: int) -> int:
    """The public 32-bit Murmur2."""
    return _murmur2_rest((seed ^ len(data)) & 0xFFFFFFFF, data)


def pwrmod(a: int, p: int, m: int) -> int:
    """a to the power p modulo m."""
    return pow(a, p, m)


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC32C = _crc_table()


def crc32c_value(data: bytes, crc: int = 0) -> int:
    """Castagnoli CRC, bit-reflected."""
    crc ^= 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ _CRC32C[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF


def compression_ratio(data: bytes) -> int:
    """Tenths: size * 10 / deflated size, at most 255."""
    return min(255, len(data) * 10 // len(zlib.compress(data, 6))) if data else 0


#: Rows that are still going on, below which a lane of the batch is left to the one-row form.
_LEAST_LANES = 24


class _Batch:
    """Byte strings of a batch, longest first, for hashing them side by side: lane t of all rows that have one."""

    def __init__(self, data: pd.Series, width: int):
        rows = [b"" if b is None else bytes(b) for b in data]
        self.rows, self.width = rows, width
        self.size = np.array([len(r) for r in rows], np.int64)
        self.order = np.argsort(-self.size, kind="stable")
        self.sorted = self.size[self.order]
        joined = b"".join(rows) + b"\0" * width
        self.data = np.frombuffer(joined, np.uint8)
        self.start = (np.cumsum(self.size) - self.size)[self.order]
        lanes = self.sorted // width
        #: lanes that at least _LEAST_LANES rows have
        self.common = int(lanes[_LEAST_LANES - 1]) if len(lanes) >= _LEAST_LANES else 0

    def lanes(self):  # noqa: ANN201
        """(rows, bytes as unsigned numbers of 4 or 8 bytes) of each common lane."""
        within = np.arange(self.width)
        kind = {1: np.uint8, 4: "<u4"}.get(self.width, "<u8")
        for t in range(self.common):
            k = int(np.searchsorted(-self.sorted, -(t + 1) * self.width, "right"))
            yield k, self.data[self.start[:k, None] + t * self.width + within].view(kind)

    def finish(self, f) -> list:  # noqa: ANN001
        """f(row number in order, its bytes behind the lanes that it took part in) for each row, in the batch's order."""
        out = [None] * len(self.rows)
        for i, row in enumerate(self.order.tolist()):
            out[row] = f(i, self.rows[row][min(self.common, len(self.rows[row]) // self.width) * self.width :])
        return out


def murmur2_batch(data: pd.Series, seed: int) -> list[int]:
    b = _Batch(data, 4)
    m = np.uint32(0x5BD1E995)
    h = np.uint32(seed) ^ b.sorted.astype(np.uint32)
    for n, lane in b.lanes():
        k = lane[:, 0] * m
        h[:n] = (h[:n] * m) ^ ((k ^ (k >> np.uint32(24))) * m)
    return b.finish(lambda i, rest: _murmur2_rest(int(h[i]), rest))


def murmur3_batch(data: pd.Series, seed: int = MURMUR3_SEED) -> list[bytes]:
    b = _Batch(data, 16)
    u = np.uint64
    rot = lambda x, r: (x << u(r)) | (x >> u(64 - r))
    c1, c2 = u(_C1), u(_C2)
    h1 = np.full(len(b.rows), seed, u)
    h2 = h1.copy()
    for n, lane in b.lanes():
        h1[:n] = (rot(h1[:n] ^ (rot(lane[:, 0] * c1, 31) * c2), 27) + h2[:n]) * u(5) + u(0x52DCE729)
        h2[:n] = (rot(h2[:n] ^ (rot(lane[:, 1] * c2, 33) * c1), 31) + h1[:n]) * u(5) + u(0x38495AB5)
    return b.finish(lambda i, rest: _murmur3_rest(int(h1[i]), int(h2[i]), rest, int(b.sorted[i])))


def crc32c_batch(data: pd.Series) -> list[int]:
    b = _Batch(data, 1)
    table = np.array(_CRC32C, np.uint32)
    crc = np.full(len(b.rows), 0xFFFFFFFF, np.uint32)
    for n, lane in b.lanes():
        crc[:n] = (crc[:n] >> np.uint32(8)) ^ table[(crc[:n] ^ lane[:, 0]) & np.uint32(255)]
    return b.finish(lambda i, rest: crc32c_value(rest, int(crc[i]) ^ 0xFFFFFFFF))


def _known(data: pd.Series, found: list, kind: str) -> pd.Series:
    return pd.Series(found, dtype=kind).where(data.notna().to_numpy(), None)


@F.pandas_udf(StringType())
def murmur3(data: pd.Series) -> pd.Series:
    return _known(data, [x.hex() for x in murmur3_batch(data)], "object")


@F.pandas_udf(LongType())
def murmur2(data: pd.Series) -> pd.Series:
    return _known(data, murmur2_batch(data, BLOOM_SEED), "Int64")


@F.pandas_udf(LongType())
def crc32c(data: pd.Series) -> pd.Series:
    return _known(data, crc32c_batch(data), "Int64")


@F.pandas_udf(IntegerType())
def zlib_ratio(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else compression_ratio(bytes(b))).astype("Int32")


def hash_column(data: Column, method: str) -> Column:
    """Hex digest of a binary column: md5-48bit, md5-64bit, md5, sha1, sha256 or murmur."""
    if method in ("md5-48bit", "md5-64bit"):
        return F.substring(F.md5(data), 1, 12 if method == "md5-48bit" else 16)
    native = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "murmur": murmur3}
    return native[method](data)


def ratio_column(data: Column, method: str = "none") -> Column:
    return F.lit(10) if method == "none" else zlib_ratio(data)


def rekey(fp: Column, key_fp: Column) -> Column:
    """First 6 bytes of the MD5 of fingerprint and key fingerprint, as raw bytes one after another."""
    return F.substring(F.md5(F.unhex(F.concat(fp, key_fp))), 1, 12)


def hex_bits(fp: Column) -> Column:
    """Hex digits -> string of bits, eight a byte."""
    return F.lpad(F.conv(fp, 16, 2), F.length(fp) * 4, F.lit("0"))


def bits_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.conv(bits, 2, 16)), (F.length(bits) / 4).cast("int"), F.lit("0"))


def size_text(size: Column) -> Column:
    return F.when(size >= 1024, F.concat(F.floor(size / 1024).cast("string"), F.lit(" KB"))).otherwise(F.concat(size.cast("string"), F.lit(" B")))


def parse_colon_hash(text: Column) -> Column:
    """aa:bb:... -> hex digits, null for anything else."""
    return F.when(text.rlike("^[0-9a-fA-F]{2}(:[0-9a-fA-F]{2})*$"), F.lower(F.regexp_replace(text, ":", "")))


def is_extension(text: Column) -> Column:
    return text.rlike("^(?=.*[A-Za-z])[A-Za-z0-9]{1,4}$")


def file_type(path: Column) -> Column:
    """The last extension of a path's last part and what follows it; empty if there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, r"(\.(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{1,4}(?:\.(?!(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{1,4}(?:\.|$))[^.]*)*)$", 1)


def anonymize_path(key: str):  # noqa: ANN201
    """Keyed one-way pseudonyms (HMAC-SHA256, 16 hex digits) for each part of a path; a leading slash and the file type stay.

    No block cipher of the original kind is in the standard library, so this does not decrypt; pseudonyms of equal parts
    are equal, which is what statistics over paths need.
    """

    @F.pandas_udf("string")
    def run(paths: pd.Series, types: pd.Series) -> pd.Series:
        def one(path: str | None, kind: str | None) -> str | None:
            if path is None:
                return None
            body = path[: len(path) - len(kind)] if kind else path
            parts = [hmac.new(key.encode(), p.encode(), "sha256").hexdigest()[:16] if p else "" for p in body.split("/")]
            return "/".join(parts) + (kind or "")

        return pd.Series([one(p, k) for p, k in zip(paths, types)])

    return lambda path: run(path, file_type(path))


def reveal_paths(anonymous: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """anonymous with `original`: the known path (column path) of that pseudonym under the key, null where none is known.

    Pseudonyms are one-way, so paths come back by making those of the known ones and joining.
    """
    made = known.select(F.col("path").alias("original")).distinct().withColumn("path", anonymize_path(key)(F.col("original")))
    return anonymous.join(made, "path", "left")


def anonymize_tables(files: DataFrame, chunks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Entries and chunks of hash files with pseudonyms for paths, link targets and fingerprints; all other fields stay."""
    hide = anonymize_path(key)
    files = files.withColumns({c: hide(F.col(c)) for c in ("path", "target_path") if c in files.columns})
    chunks = chunks.withColumn("fp", anonymize_fp(F.col("fp"), key))
    return files, chunks.withColumn("path", hide(F.col("path"))) if "path" in chunks.columns else chunks


def anonymize_fp(fp: Column, key: str) -> Column:
    """Keyed one-way pseudonym of a fingerprint, of the same length."""
    return F.substring(F.md5(F.concat(F.lit(key.encode()), F.unhex(fp))), F.lit(1), F.length(fp))
