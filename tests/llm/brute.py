"""Plain versions of the operators, for small tables."""

import hashlib
import re

import regex
import xxhash


def shingles(text: str) -> frozenset:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets = [(i, shingles(t)) for i, t in rows]
    best = {i: i for i, _ in sets}
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            changed |= best[a] != low or best[b] != low
            best[a] = best[b] = low
    return best


def without_repeats(rows: list[tuple[int, str]], size: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            w = raw[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def secrets(text: str) -> list[tuple[str, int, int]]:
    rules = [
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(rules) for m in re.finditer(p, text) if len(m[g]) >= n]
    return [(name, a, b) for a, _, name, b in sorted(found)]


def passes(equal: list[bool], least: int) -> bool:
    """Whether a stretch has that many equal tokens, and three quarters of its tokens equal."""
    n = len(equal)
    return any(sum(equal[i:j]) >= max(least, 0.75 * (j - i)) for i in range(n) for j in range(i + least, n + 1))


ALONE = r"\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}"


def _hash(*values) -> int:
    """Spark's xxhash64 of texts and numbers (a pair of number and bytes), signed; each value's hash seeds the next one's."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def order_minhash(text: str, k: int = 3, bins: int = 64) -> list[int]:
    """A signature as the docstring of the operator describes it, k-mer by k-mer."""
    tokens = regex.findall(rf"[{ALONE}]|[^{ALONE} \t\n\r\f\x0b]{{1,16}}", text) or [""]
    h = [_hash(t) for t in tokens]
    counts: dict[int, int] = {}
    kmers = []  # (34 bits of the hash, position), later occurrences having hashes of their own
    for i in range(max(1, len(h) - k + 1)):
        v = _hash(*[(x, 8) for x in h[i : i + k]]) >> 30
        o = counts[v] = counts.get(v, -1) + 1
        kmers.append((v if not o else _hash((v, 8), (o, 4)) >> 30, i))

    def two(entries):
        return [(v, i) for *_, v, i in sorted(entries)[:2]]

    out = []
    for b in range(-bins // 2, bins // 2):
        own = two([x for x in kmers if x[0] >> 28 == b])
        if len(own) < 2:
            rest = [(_hash((v, 8), (b, 8)) >> 30, v, i) for v, i in kmers if (v, i) not in own]
            own += two(rest)[: 2 - len(own)]
        value = _hash(*[(v, 8) for v, _ in sorted(own, key=lambda x: x[1])])
        out.append(((b + bins // 2) << 32) | (value & 0xFFFFFFFF))
    return out
