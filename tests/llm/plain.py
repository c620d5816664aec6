"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import sentencepiece
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@cache
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def packed(text: str) -> dict[int, tuple[int, int, int]]:
    """By piece: start, length, CRC-32 of the ids."""
    ids = tokenizer().encode(text or "", add_special_tokens=False).ids + [1]
    parts = [(k, ids[k : k + 4096]) for k in range(0, len(ids), 4096)]
    return {k // 4096: (k, len(p), zlib.crc32(np.array(p, np.uint32).tobytes())) for k, p in parts}


def simhash(text: str) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints: dict[int, int]) -> dict[int, int]:
    """Smallest id reachable over links of at most four bits."""
    ids = sorted(fingerprints)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([fingerprints[d] for d in ids], np.uint64)
    for i, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4):
            a, b = root(d), root(ids[i + 1 + int(j)])
            parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in ids}


def without_repeats(texts: list[str], size: int = 20) -> list[tuple[int, int, str]]:
    """Number of words, of removed ones, and the kept words, of texts in order."""
    seen, out = set(), []
    for text in texts:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        out.append((len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def personal(text: str) -> list[tuple[int, int, int]]:
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def joined(spans) -> str:
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in spans)


def measures(text: str) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def byte_tokenizer(special: bool):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = not special
    return own


def served(sizes: list[int], quanta: list[float], portion: int, rounds: int) -> list[list[int]]:
    """Tokens that deficit round-robin takes from each queue in each round, one round after another."""
    deficit, left, out = [0.0] * len(sizes), list(sizes), []
    for k in range(rounds):
        taken = []
        for q in range(len(sizes)):
            deficit[q] += quanta[q]
            n = min(left[q], int(deficit[q] // portion) * portion)
            if quanta[q] * (k + 1) >= sizes[q]:
                n = left[q]
            deficit[q] -= n
            left[q] -= n
            taken.append(n)
        out.append(taken)
    return out


def aligned(texts: list[str | None]) -> list[tuple]:
    """Rows of both tokenizers' alignment, by comparing the byte ranges of all tokens."""
    a_own, b_own = byte_tokenizer(False), pieces()
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters)}
    rows, links = [], []
    for text in texts:
        empty = ([], [], [], [])
        if text:
            a = a_own.encode(" " + text, add_special_tokens=False).ids
            b = b_own.encode(text)
            spelled_a = [bytes(symbol[c] for c in a_own.id_to_token(i)) for i in a]
            spelled_b = [bytes([int(p[3:5], 16)]) if b_own.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in ((i, b_own.id_to_piece(i)) for i in b)]
            data = (" " + text).encode()
            if b"".join(spelled_a) == data and b"".join(spelled_b) == data:
                empty = (a, b, np.cumsum([len(x) for x in spelled_a]).tolist(), np.cumsum([len(x) for x in spelled_b]).tolist())
        a, b, ends_a, ends_b = empty
        starts_a, starts_b = [0, *ends_a], [0, *ends_b]
        own = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]]
        groups, common = [], sorted(set(ends_a) & set(ends_b))
        for low, high in zip([0, *common], common):
            groups.append(",".join(str(x) for x, e in zip(a, ends_a) if low < e <= high) + "|" + ",".join(str(x) for x, e in zip(b, ends_b) if low < e <= high))
        links.append(own)
        rows.append((len(a), len(b), len(groups), len(own), sha(";".join(groups)) if a else ""))
    counts = Counter(x for own in links for x in own)
    best: dict[int, int] = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return [(*row[:4], sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), row[4]) for row, own in zip(rows, links)]


def trie(rows: list[tuple]) -> list[tuple]:
    """Nodes of the prefix trie of rebuilt conversations, from rows of conv_id, turn, role and text."""
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members: dict[tuple, list[int]] = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children: dict[tuple, list[tuple]] = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in kids) or 1
        saved[node] = sum(saved[k] for k in kids) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n],
         sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(n))))
        for n, m in members.items())


def winnowed(text: str, gram: int = 3, window: int = 6) -> list[int]:
    """Kept hashes in order of place, with repeats: each gram hashed from its word hashes, each window's least with the rightmost of ties."""
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    grams = []
    for i in range(max(1, len(hashes) - gram + 1) if hashes else 0):
        mixed = 42
        for h in hashes[i : i + gram]:
            mixed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), mixed)
        grams.append(mixed >> 25)
    places = []
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        own = range(i, min(i + window, len(grams)))
        place = min(own, key=lambda k: (grams[k], -k))
        if place not in places[-1:]:
            places.append(place)
    return [grams[k] for k in places]


def ring_walk(rows: list[tuple[int, str]], places: list[tuple[int, int]], shards: int) -> Counter:
    """Rows for each arc and shard, row by row: every row asks the shards clockwise of its hash, all rows their first one first."""
    arcs = []
    for doc_id, text in rows:
        h = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42))
        h -= (h >> 63) << 64
        arcs.append(sum(p < h for p, _ in places) % len(places))
    free = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    waiting, placed, asked = sorted(arcs), Counter(), 0
    while waiting:
        left = []
        for arc in waiting:
            order = list(dict.fromkeys(places[(arc + k) % len(places)][1] for k in range(len(places))))
            if free[order[asked]]:
                free[order[asked]] -= 1
                placed[arc, order[asked]] += 1
            else:
                left.append(arc)
        waiting, asked = left, asked + 1
    return placed
