"""What the contracts say, in plain Python, row by row."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def contamination(docs, benchmark):
    owners = defaultdict(set)
    for item, text in benchmark:
        words = _ITEM_WORD.findall((text or "").translate(_LOWER))
        size = min(10, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            owners[tuple(words[at : at + size])].add(item)
    sizes = {len(w) for w in owners}
    out = []
    for doc_id, text in docs:
        words, hit, items = _ITEM_WORD.findall((text or "").translate(_LOWER)), set(), set()
        for size in sizes:
            for at in range(len(words) - size + 1):
                if tuple(words[at : at + size]) in owners:
                    hit |= set(range(at, at + size))
                    items |= owners[tuple(words[at : at + size])] - {None}
        out.append((doc_id, len(words), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit)))
    return out


def substrings(docs, size=20):
    """Ids are distinct and not null here."""
    seen, out = set(), []
    for doc_id, text in sorted(docs):
        words, gone = _WORD.findall(text or ""), set()
        for at in range(len(words) - size + 1):
            window = tuple(words[at : at + size])
            if window in seen:
                gone |= set(range(at, at + size))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), sha(kept)))
    return out


def tokens(docs):
    import public_tokenizers
    import tiktoken

    lines = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for doc_id, text in docs:
        ids = coder.encode_ordinary(text or "")
        out.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(coder.decode_bytes(ids))))
    return out


def simhash(text) -> int:
    import xxhash

    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, bits=2):
    """Smallest reachable place of each fingerprint, every pair compared."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def _luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _digits(s):
    return re.sub("[^0-9]", "", s)


_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(_digits(s)) <= 19 and _luhn(_digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(_digits(s)) <= 15),
]


def personal(docs):
    out = []
    for doc_id, text in docs:
        found = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m[0])] for k, p, ok in _PII]
        out.append((doc_id, *map(len, found), sha(",".join(sum(found, [])))))
    return out


def chats(rows):
    """Rows (conv_id, turn, role, text) with distinct turns."""
    talk = defaultdict(list)
    for conv_id, _, role, text in sorted(rows, key=lambda r: r[1]):
        talk[conv_id].append((role or "", text or ""))
    talk[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    out = []
    for conv_id, turns in talk.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return out
