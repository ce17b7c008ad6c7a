"""Hashes of keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 32-bit string hash: seed, two mixers, and the finaliser's multipliers.
SEED, C1, C2, ADD, F1, F2 = 0xF7CA7FD2, 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
#: Fixed value: what a key's integer hash is offset by before it is hashed as a string.
OFFSET = 123456791


def text(key: Column) -> Column:
    return key.cast("string")


def md5_unit(key: Column) -> Column:
    """A portable hash in [0, 1): the first 32 bits of the md5 of the key as text."""
    return F.conv(F.substring(F.md5(text(key)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def modulo(key: Column, n: int) -> Column:
    """Non-negative remainder of an integer key; null goes to partition 0."""
    return F.coalesce(F.pmod(key.cast("bigint"), F.lit(n)), F.lit(0)).cast("int")


def hash_partition(key: Column, n: int) -> Column:
    """Partition of a key of any type by the portable hash; null goes to partition 0."""
    return F.coalesce(F.floor(md5_unit(key) * n), F.lit(0)).cast("int")


def _wrap(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _times(x: Column, c: int) -> Column:
    """Product of two unsigned 32-bit numbers modulo 2^32, without exceeding 64 bits."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
    return _wrap(low * c + _wrap(high * (c & 0xFFFF)) * 65536)


def _rotate(x: Column, r: int) -> Column:
    return _wrap(F.shiftleft(x, r)).bitwiseOR(F.shiftright(x, 32 - r))


def string_mmh3(value: Column) -> Column:
    """The 32-bit murmur3 of a string taken two UTF-16 units at a time (signed int).

    Matches the JVM library function of that name for characters of the basic plane.  A fold over
    the string's characters, inside the JVM.
    """
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c).cast("bigint"))
    n = F.size(codes)
    pairs = F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1)

    def block(h: Column, k: Column) -> Column:
        x = _times(_rotate(_times(k, C1), 15), C2)
        return _wrap(_times(_rotate(_mix(h, x), 13), 5) + ADD)

    def folded(c: Column) -> Column:
        start = F.lit(SEED).cast("bigint")
        body = F.when(F.size(c) < 2, start).otherwise(F.aggregate(pairs, start, lambda h, i: block(h, _wrap(F.shiftleft(c[2 * i], 16) + c[2 * i + 1]))))
        tail = _times(_rotate(_times(F.get(c, F.size(c) - 1), C1), 15), C2)
        return F.when(F.size(c) % 2 == 1, _mix(body, tail)).otherwise(body)

    hashed = F.transform(F.array(F.when(value == "", F.array().cast("array<bigint>")).otherwise(codes)), folded)[0]
    return F.transform(F.array(_mix(hashed, F.when(value == "", F.lit(0)).otherwise(n).cast("bigint"))), _final)[0].cast("int")


def _mix(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _final(h: Column) -> Column:
    h = _mix(h, F.shiftright(h, 16))
    h = F.transform(F.array(_times(h, F1)), lambda x: _mix(x, F.shiftright(x, 13)))[0]
    h = F.transform(F.array(_times(h, F2)), lambda x: _mix(x, F.shiftright(x, 16)))[0]
    return F.when(h >= 2**31, h - 2**32).otherwise(h)


def java_string_hash(value: Column) -> Column:
    """The JVM's hashCode of a string of basic-plane characters (signed int)."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(F.when(value == "", F.array().cast("array<bigint>")).otherwise(codes), F.lit(0).cast("bigint"), lambda h, c: _wrap(h * 31 + c))
    return F.when(h >= 2**31, h - 2**32).otherwise(h).cast("int")


def mmh3_unit(hash_code: Column) -> Column:
    """The ring's own hash in [0, 1] of a key's integer hash code (32-bit wrap before it becomes text)."""
    x = _wrap(hash_code.cast("bigint") + OFFSET)
    signed = F.when(x >= 2**31, x - 2**32).otherwise(x)
    return (string_mmh3(signed.cast("string")) / F.lit(2147483647.0) + 1) / 2


def _mixed_word(k: Column) -> Column:
    return _times(_rotate(_times(k, C1), 15), C2)


def _finished(h: Column, length: Column) -> Column:
    return F.transform(F.array(_mix(h, length)), _final)[0].cast("int")


def murmur3_int(value: Column, seed: int = 0) -> Column:
    """The 32-bit murmur3 of an int's four bytes (signed int)."""
    word = _wrap(value.cast("bigint"))
    return _finished(_wrap(_times(_rotate(_mix(F.lit(seed).cast("bigint"), _mixed_word(word)), 13), 5) + ADD), F.lit(4).cast("bigint"))


def murmur3_string(value: Column, seed: int = 0) -> Column:
    """The 32-bit murmur3 of a string's UTF-8 bytes (signed int)."""
    digits = F.hex(F.encode(value, "UTF-8"))
    n = F.octet_length(value)
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")

    def word(i: Column) -> Column:
        return sum((F.shiftleft(byte(4 * i + j), 8 * j) for j in range(1, 4)), byte(4 * i))

    start = F.lit(seed).cast("bigint")
    whole = F.floor(n / 4).cast("int")
    blocks = F.aggregate(F.sequence(F.lit(0), whole - 1), start, lambda h, i: _wrap(_times(_rotate(_mix(h, _mixed_word(word(i))), 13), 5) + ADD))
    body = F.when(whole > 0, blocks).otherwise(start)
    rest = sum((F.when(n % 4 > j, F.shiftleft(byte(4 * whole + j), 8 * j)).otherwise(0) for j in range(3)), F.lit(0).cast("bigint"))
    return _finished(F.when(n % 4 > 0, _mix(body, _mixed_word(rest))).otherwise(body), n.cast("bigint"))


def murmur3_text(key: Column) -> Column:
    """:func:`murmur3_string` of a key as text; null stays null."""
    return murmur3_string(text(key))


def _rotated(x: int, r: int) -> int:
    return (x << r | x >> 32 - r) & 0xFFFFFFFF


def _avalanched(h: int) -> int:
    h = (h ^ h >> 16) * F1 & 0xFFFFFFFF
    h = (h ^ h >> 13) * F2 & 0xFFFFFFFF
    return _signed(h ^ h >> 16)


def _signed(h: int) -> int:
    return h - (1 << 32) if h >> 31 else h


def _folded(words: list[int], seed: int, length: int) -> int:
    h = seed
    for k in words:
        h ^= _rotated(k * C1 & 0xFFFFFFFF, 15) * C2 & 0xFFFFFFFF
        h = (_rotated(h, 13) * 5 + ADD) & 0xFFFFFFFF
    return _avalanched(h ^ length)


def murmur3_pair(a: int, b: int) -> int:
    """The 32-bit murmur3 of two ints as eight big-endian bytes: points of a ring are few, so in Python."""
    words = [int.from_bytes((x & 0xFFFFFFFF).to_bytes(4, "big"), "little") for x in (a, b)]
    return _folded(words, 0, 8)


#: Fixed value: the seed of the JVM's hash code of a pair.
PAIR_SEED = 0xCAFEBABE


def pair_hash_code(a: int, b: int) -> int:
    """The JVM hash code of a pair of ints."""
    return _folded([a & 0xFFFFFFFF, b & 0xFFFFFFFF], PAIR_SEED, 2)
