"""IP addresses and identifiers as JVM expressions; BLAKE3, which the JVM lacks, in Arrow batches."""

from __future__ import annotations

import ipaddress

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"
V6 = r"(?i)^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::)?(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$"


def bits(ip: Column) -> Column:
    """The 32 or 128 binary digits of an address as text; a malformed one is an error."""

    def digits(parts: Column, base: int, width: int) -> Column:
        return F.array_join(F.transform(parts, lambda x: F.lpad(F.conv(x, base, 2), width, "0")), "")

    def groups(part: Column) -> Column:
        return F.array_remove(F.split(part, ":"), "")

    halves = F.split(ip, "::")
    head, tail = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    missing = 8 - F.size(head) - F.size(tail)
    fits = F.when(F.size(halves) == 2, missing >= 1).otherwise((F.size(halves) == 1) & (missing == 0))
    six = F.concat(digits(head, 16, 16), F.repeat(F.lit("0"), missing * 16), digits(tail, 16, 16))
    wrong = F.raise_error(F.concat(F.lit("not an address: "), ip)).cast("string")
    return F.when(ip.rlike(V4), digits(F.split(ip, r"\."), 10, 8)).when(ip.contains(":") & ip.rlike(V6) & fits, six).when(ip.isNotNull(), wrong)


def in_network(ip: Column, cidr: Column) -> Column:
    """ip << cidr, for IPv4 and IPv6, in the JVM; null if either is null, an error if either is malformed."""
    a, b = bits(ip), bits(F.split_part(cidr, F.lit("/"), F.lit(1)))
    size = F.nullif(F.split_part(cidr, F.lit("/"), F.lit(2)), F.lit("")).cast("int")
    size = F.coalesce(size, F.char_length(b))
    same = (F.char_length(a) == F.char_length(b)) & (F.substr(a, F.lit(1), size) == F.substr(b, F.lit(1), size))
    return F.when(a.isNotNull() & b.isNotNull(), same)


def in_network4(ip: Column, cidr: str) -> Column:
    """The same for IPv4 and a fixed network, in the JVM: bits of the address compared under the mask; null if it is no IPv4 address."""
    net = ipaddress.IPv4Network(cidr, strict=False)
    parts = F.split(ip, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x.try_cast("long"))
    return number.bitwiseAND(F.lit(int(net.netmask))) == F.lit(int(net.network_address))


PART = r'\s*+(?:"(?:[^"]|"")+"|[\p{L}_][\p{L}\p{N}_$]*+)\s*+'


def parse_ident(s: Column, strict: bool = True) -> Column:
    """The parts of a dotted identifier, in the JVM: unquoted ones lower-cased, quoted ones as they are; strict rejects
    what follows."""
    names = rf"^{PART}(?:\.{PART})*"
    whole = F.regexp_extract(s, names, 0)
    fits = s.rlike(names + "$" if strict else names)
    parts = F.transform(F.regexp_extract_all(whole, F.lit(PART), F.lit(0)), lambda x: F.trim(x))
    bare = F.transform(parts, lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.char_length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(F.lower(x)))
    wrong = F.raise_error(F.concat(F.lit("not a valid identifier: "), s)).cast("array<string>")
    return F.when(fits, bare).when(s.isNotNull(), wrong)


IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
STEPS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
START, END, PARENT, ROOT = 1, 2, 4, 8


def compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The function of BLAKE3's paper for many blocks at once: cv (8, n), words (16, n), the others (n); all of 32 bits."""
    n = cv.shape[1]
    zero = np.zeros(n, np.uint32)
    v = [*cv, *(np.full(n, x, np.uint32) for x in IV[:4]), counter.astype(np.uint32), zero, size.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words)
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(STEPS):
            for word, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = v[a] + v[b] + word
                x = v[d] ^ v[a]
                v[d] = (x >> np.uint32(r1)) | (x << np.uint32(32 - r1))
                v[c] = v[c] + v[d]
                x = v[b] ^ v[c]
                v[b] = (x >> np.uint32(r2)) | (x << np.uint32(32 - r2))
        m = [m[i] for i in ORDER]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def blake3_many(messages: list[bytes]) -> list[str]:
    """BLAKE3 with 32 bytes of output. The chunks of all messages go block by block in step, then each level of their trees:
    neighbours are joined, and what is left over at the end goes up as it is. Counters are of 32 bits: 4 TB a message."""
    sizes = np.array([len(m) for m in messages], dtype=np.int64)
    counts = np.maximum(1, -(-sizes // 1024))
    owner = np.repeat(np.arange(len(messages)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    data = np.frombuffer(b"".join(m.ljust(1024 * c, b"\0") for m, c in zip(messages, counts.tolist())), dtype="<u4").reshape(len(owner), 16, 16)
    left = np.clip(sizes[owner] - place * 1024, 0, 1024)
    blocks = np.maximum(1, -(-left // 64))
    top = np.where(counts[owner] == 1, ROOT, 0)
    cv = np.repeat(np.array(IV, dtype=np.uint32)[:, None], len(owner), axis=1)
    for b in range(int(blocks.max()) if len(blocks) else 0):
        on = np.nonzero(blocks > b)[0]
        flags = np.where(blocks[on] == b + 1, END | top[on], 0) | (START if b == 0 else 0)
        cv[:, on] = compress(cv[:, on], data[on, b].T.astype(np.uint32), place[on], np.minimum(64, left[on] - b * 64), flags)
    while len(owner) > len(messages):
        held = np.bincount(owner, minlength=len(messages))
        first = np.cumsum(held) - held
        at = np.arange(len(owner)) - first[owner]
        a = np.nonzero((at % 2 == 0) & (at + 1 < held[owner]))[0]
        joined = compress(np.repeat(np.array(IV, dtype=np.uint32)[:, None], len(a), axis=1), np.concatenate([cv[:, a], cv[:, a + 1]]), np.zeros(len(a)), np.full(len(a), 64), PARENT | np.where(held[owner[a]] == 2, ROOT, 0))
        cv[:, a] = joined
        keep = at % 2 == 0
        cv, owner = cv[:, keep], owner[keep]
    return [x.tobytes().hex() for x in np.ascontiguousarray(cv.T.astype("<u4"))]


def blake3_hex(data: bytes) -> str:
    return blake3_many([data])[0]


def blake3(s: Column) -> Column:
    @F.pandas_udf("string")
    def f(x: pd.Series) -> pd.Series:
        out, known = pd.Series([None] * len(x), dtype=object), np.nonzero(x.notna().to_numpy())[0]
        for at in range(0, len(known), 1000):
            part = known[at : at + 1000]
            out.iloc[part] = blake3_many([x.iloc[i].encode() for i in part])
        return out

    return f(s)
