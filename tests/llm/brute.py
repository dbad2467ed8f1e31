"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from functools import cache

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(rows):
    """(doc_id, text) rows: list of (shingles, component id), in the order of the rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    parent[top(i)] = top(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[top(i)].append(d)
    return [
        (len(s), min((d for d in low[top(i)] if d is not None), default=None) if s else rows[i][0])
        for i, s in enumerate(sets)
    ]


def repeats(texts, least=200):
    """(bytes, removed, spans, digest of what remains) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        end = 0
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                for k in range(max(i, end), i + least):
                    gone[k] = True
                end = i + least
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


KINDS = ("assign", "access", "hex", "pem", "forge", "chat", "jwt")
_SECRETS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
    "pem": (r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0),
    "forge": (r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}", 0, 0),
    "chat": (r"xox[abprs]-[0-9A-Za-z-]{10,}", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
}


def secrets(text):
    """Counts of the base kinds, digest of the base spans, all spans."""
    found = []
    for place, kind in enumerate(KINDS):
        pattern, group, least = _SECRETS[kind]
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[group]) >= least:
                found.append((m.start(), place, kind, m.end()))
    found.sort()
    spelled = lambda rows: ",".join(f"{k}:{a}:{z}" for a, _, k, z in rows)
    base = [x for x in found if x[1] < 3]
    counts = Counter(x[2] for x in base)
    return (*[counts[k] for k in KINDS[:3]], hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(found))


@cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def records(rows):
    """(doc_id, start, n_tokens, crc) of (doc_id, text) rows in their order of output."""
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = tokenizer().encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def normal_line(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[1-9]", "0", line.lower())).strip(" ")


def quality(docs, max_docs=100, max_lost=70):
    """Rows (doc_id, text, source) that pass, with their text after boilerplate lines are out."""
    holders, words = defaultdict(dict), {}
    for d, t, s in docs:
        for line in (t or "").split("\n"):
            if WORD.search(line):
                key = (s, normal_line(line))
                holders[key][t] = min(holders[key].get(t, d), d)
    common = {k: min(v, key=v.get) for k, v in holders.items() if len(v) > max_docs}
    out = []
    for d, t, s in docs:
        words = WORD.findall(t or "")
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        cover = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = (t or "").split("\n")
        bad = [bool(WORD.search(x)) and common.get((s, normal_line(x)), t) != t for x in lines]
        lost = sum(len(WORD.findall(x)) for x, b in zip(lines, bad, strict=True) if b)
        if len(words) >= 10 and 100 * len(cover) <= 20 * len(words) and 100 * lost <= max_lost * len(words):
            out.append((d, "\n".join(x for x, b in zip(lines, bad, strict=True) if not b), s))
    return out


def clean(docs, items, percent=80):
    sets = [x for x in map(shingles, items) if x]
    return [r for r in docs if not any(100 * len(shingles(r[1]) & x) >= percent * len(x) for x in sets)]


def mix(docs, weights=(3, 1, 2), percent=150, most=2, seed="mix-1"):
    """(size, source size, target, copies) of each row (doc_id, text, source)."""
    sizes = [len(WORD.findall(t or "")) for _, t, _ in docs]
    total = Counter()
    for (_, _, s), n in zip(docs, sizes, strict=True):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, level = sum(sizes) * percent / 100, 0.0
    while free := [s for s in order if most * total[s] > level * weight[s]]:
        raised = (budget - sum(most * total[s] for s in order if s not in free)) / sum(weight[s] for s in free)
        if raised <= level:
            break
        level = raised
    target = {s: min(float(most * total[s]), level * weight[s]) for s in order}
    own = lambda d, t: "null:" + hashlib.md5((t or "").encode()).hexdigest() if d is None else d
    mark = [int(hashlib.md5(f"{seed}:{own(d, t)}".encode()).hexdigest()[:15], 16) for d, t, _ in docs]
    whole = {s: int(target[s] // total[s]) if total[s] else 0 for s in order}
    cut = dict.fromkeys(order, -1)
    for s in order:
        at, own = 0, Counter()
        for (_, _, x), n, h in zip(docs, sizes, mark, strict=True):
            if x == s:
                own[h] += n
        for h in sorted(own):
            if at + own[h] / 2 <= target[s] - whole[s] * total[s]:
                cut[s] = h
            at += own[h]
    return [
        (n, total[s], target[s], min(whole[s] + (h <= cut[s]), most))
        for (_, _, s), n, h in zip(docs, sizes, mark, strict=True)
    ]


def byte_bpe(texts, path, pattern):
    """(n_tokens, digest of the ids, digest of the decoded bytes) of each text, by the library on whole texts."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = []
    for t in texts:
        ids = whole.encode_ordinary(t or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        out.append((len(ids), digest, hashlib.sha256(whole.decode_bytes(ids)).hexdigest()))
    return out


def spelled_words(rows):
    """Words of (doc_id, text) rows with their counts, some of them misspelled."""
    words = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if d is None else d}:{low}".encode())
            words[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts):
    """(word, form, root, n, n_near, form_n) of words with their counts; every pair is compared."""
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


@cache
def aligners(a, b):
    """Encoders and token bytes of a byte-level and a piece tokenizer."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(a)
    first.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}
    entries = {i: bytes(letters[c] for c in t) for t, i in first.get_vocab(with_added_tokens=False).items()}
    second = sentencepiece.SentencePieceProcessor(model_file=b)
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    return (
        lambda t: [(i, entries[i]) for i in first.encode(" " + t, add_special_tokens=False).ids],
        lambda t: [(i, piece(second.id_to_piece(i))) for i in second.encode(t)],
    )


def alignment(rows, a, b):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of (doc_id, text) rows, token by token."""
    found, counts = [], Counter()
    for d, t in rows:
        sides = [f(t) for f in aligners(a, b)] if t else [[], []]
        if not t or any(b"".join(x for _, x in s) != (" " + t).encode() for s in sides):
            found.append((d, 0, 0, 0, [], ""))
            continue
        spans = []
        for s in sides:
            at, own = 0, []
            for i, x in s:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        ends = sorted({z for _, z, _ in spans[0]} & {z for _, z, _ in spans[1]})
        groups, links, lo, places = [], [], 0, [0, 0]
        for end in ends:
            part = []
            for k, own in enumerate(spans):
                first = places[k]
                while places[k] < len(own) and own[places[k]][1] <= end:
                    places[k] += 1
                part.append(own[first : places[k]])
            groups.append("|".join(",".join(str(i) for *_, i in p) for p in part))
            links += [(x[2], y[2]) for x in part[0] for y in part[1] if x[0] < y[1] and y[0] < x[1]]
            lo = end
        found.append((d, len(spans[0]), len(spans[1]), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        counts.update(set(links))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [
        (d, na, nb, ng, len(ls), sum(counts[x] == most[x[0]] for x in ls), sum(counts[x] for x in ls), h)
        for d, na, nb, ng, ls, h in found
    ]
