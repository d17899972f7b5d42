"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut_repeats(texts, width=35):
    """For each text: words, removed words, sha of the kept words."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        covered = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                covered[i : i + width] = [True] * width
        out.append((len(w), sum(covered), sha(" ".join(x for x, c in zip(w, covered, strict=True) if not c))))
    return out


def repeated_words(text, width=8):
    w = words(text)
    windows = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
    seen, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered.update(range(i, i + width))
    return len(covered)


def fingerprint(text, width=4):
    w = words(lowered(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fingerprints, limit=4):
    """Smallest id of each row's component."""
    groups = list(range(len(ids)))
    prints = np.array(fingerprints, np.uint64)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= limit):
                least = min(groups[i], groups[j])
                if groups[i] != least or groups[j] != least:
                    groups[i] = groups[j] = least
                    changed = True
    members = defaultdict(list)
    for i, g in zip(ids, groups, strict=True):
        members[g].append(i)
    return [min((i for i in members[g] if i is not None), default=None) for g in groups]


def base_score(tokens, counts):
    total, distinct = sum(counts.values()), len(counts)
    return sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens)


def piece_names(path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_byte, model.is_control, model.is_unknown)
    return {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not any(f(i) for f in special)}


def segmentations(text, ids):
    """Every way to write a text as pieces."""
    if not text:
        return [[]]
    return [
        [text[:k], *rest] for k in range(1, len(text) + 1) if ids.get(text[:k], -1) >= 0 for rest in segmentations(text[k:], ids)
    ]


def lattice_scores(texts, held_out, path, rounds=2, smoothing=0.1):
    """log10 probability of each text: words over all segmentations, forward and backward, word by word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, n = piece_names(path), model.get_piece_size()
    longest = max(map(len, names))
    by_score = sorted(range(n), key=lambda i: (-model.get_score(i), i))
    total = math.fsum(1 / (rank + 10) for rank in range(n))
    odds = {i: 1 / (rank + 10) / total for rank, i in enumerate(by_score)}
    log_p = [math.log(odds[i]) for i in range(n)]

    def added(a, b):
        return max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)

    def steps_of(word):
        text = "▁" + word
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - longest), end):
                if text[start:end] in names:
                    yield start, end, [names[text[start:end]]]
            if text[end - 1] not in names:
                yield end - 1, end, [model.piece_to_id(f"<0x{b:02X}>") for b in text[end - 1].encode()]

    split = [words(lowered(t)) for t in texts]
    steps = {w: list(steps_of(w)) for w in {w for each in split for w in each}}

    def forward(word):
        out = [0.0] + [-math.inf] * (len(word) + 1)
        for start, end, ids in steps[word]:
            out[end] = added(out[end], out[start] + sum(log_p[i] for i in ids))
        return out

    trained = Counter(w for each, held in zip(split, held_out, strict=True) if not held for w in each)
    for _ in range(rounds):
        expected = [smoothing] * n
        expected[model.eos_id()] += sum(not held for held in held_out)
        for word, times in trained.items():
            ahead, behind = forward(word), [-math.inf] * (len(word) + 1) + [0.0]
            for start, end, ids in reversed(steps[word]):
                weight = sum(log_p[i] for i in ids)
                behind[start] = added(behind[start], behind[end] + weight)
                share = times * math.exp(ahead[start] + weight + behind[end] - ahead[-1])
                for i in ids:
                    expected[i] += share
        total = math.fsum(expected)
        log_p = [math.log(x / total) for x in expected]
    of_word = {w: forward(w)[-1] for w in steps}
    return [(log_p[model.eos_id()] + math.fsum(of_word[w] for w in each)) / math.log(10) for each in split]


def prefix_trie(turns, base=lambda c: c, taken=lambda c: 0):
    """Rows of the trie from (conv_id, turn, role, text), by following every path."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, f"{role or ''}\n{text or ''}", (role or "", text or "")))
    own = {c: [x[3] for x in sorted(rows, key=lambda r: r[:3])] for c, rows in own.items()}
    paths = {c: tuple(own.get(base(c), [])[: taken(c)] + rows[taken(c) :]) for c, rows in own.items()}
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (
            min(convs),
            len(node),
            min(members[node[:-1]]) if node else None,
            len(convs),
            children[node],
            leaves[node],
            saved[node],
            sha(",".join(str(c) for c in sorted(convs) if paths[c] == node)),
        )
        for node, convs in members.items()
    )


def spelling(rows, least_length=7, least_times=2, ratio=10):
    """Rows of spelling groups from (doc_id, text), by all one-character patterns of each word."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_times}
    patterns = defaultdict(set)
    for w in counts:
        for i in range(len(w) + 1):
            patterns[w[:i] + "?" + w[i:]].add(w)
            if i < len(w):
                patterns[w[:i] + "?" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in patterns.values():
        for a in group:
            near[a] |= group - {a}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def archived(pages, least=1000):
    """Rows of the archive index from (page_id, html)."""
    payloads = [(page_id, (html or "").encode()) for page_id, html in pages]
    largest = {}
    for page_id, data in payloads:
        largest[data] = max(largest.get(data, page_id), page_id)
    return sorted(
        (
            page_id,
            len(data),
            hashlib.sha1(data).hexdigest(),
            "revisit" if len(data) >= least and largest[data] != page_id else "response",
            largest[data] if len(data) >= least and largest[data] != page_id else None,
        )
        for page_id, data in payloads
    )


def quality_kept(docs, labels, settings, risk, doubt):
    """Which of (doc_id, text, lang) the base rule and certified thresholds keep."""
    measured = []
    for doc_id, text, lang in docs:
        w, text = words(text), text or ""
        lines = [x for x in text.split("\n") if words(x)]
        repeats, chars = repeated_words(text), sum(map(len, w))
        share = {
            "symbol_ratio": (sum(text.count(c) for c in "#*$%&|<>"), chars),
            "dup_line_ratio": (len(lines) - len(set(lines)), len(lines)),
            "repeat_ratio": (repeats, len(w)),
            "upper_ratio": (sum("A" <= c <= "Z" for c in text), chars),
        }
        failed = len(w) < 20 or 100 * repeats > 30 * len(w)
        measured.append((doc_id, lang, failed, {k: a / b if b else 0.0 for k, (a, b) in share.items()}))
    quality = {}
    for doc_id, q in labels:
        if doc_id is not None and q is not None:
            quality[doc_id] = max(q, quality.get(doc_id, q))
    good = defaultdict(dict)
    for doc_id, lang, _, m in measured:
        if quality.get(doc_id) == 1:
            old = good[lang].get(doc_id, m)
            good[lang][doc_id] = {k: max(m[k], old[k]) for k in m}

    def tail(k, n):
        return sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))

    sizes = [len(x) for x in good.values()]
    tests = next(t for t in range(1, len(sizes) + 2) if sum((1 - risk) ** n <= doubt / t for n in sizes) <= t)
    cutoffs = {}
    for lang, of_good in good.items():
        if (1 - risk) ** len(of_good) > doubt / tests:
            continue
        for setting in settings:
            rejected = sum(any(m[k] > c for k, c in setting.items()) for m in of_good.values())
            if rejected > risk * len(of_good) or tail(rejected, len(of_good)) > doubt / tests:
                break
            cutoffs[lang] = setting
    return [not failed and not any(m[k] > c for k, c in cutoffs.get(lang, {}).items()) for _, lang, failed, m in measured]


def cut_texts(texts, width=35):
    """Each text without its repeated words and the white space behind each of them."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for text, w in zip(texts, split, strict=True):
        covered = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        if not covered:
            out.append(text)
            continue
        starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
        out.append(text[: starts[0]] + "".join(text[starts[i] : starts[i + 1]] for i in range(len(w)) if i not in covered))
    return out


def poisson_copies(rows, exponent, seed):
    """Copies of each (doc_id, source)."""
    present = Counter(source for _, source in rows)
    weight = {s: n**exponent for s, n in present.items()}
    rate = {s: float(f"{weight[s] / sum(weight.values()) * len(rows) / n:.8e}") for s, n in present.items()}
    out = []
    for doc_id, source in rows:
        u = int(hashlib.md5(f"{seed}|{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, total = 0, math.exp(-rate[source])
        while total <= u:
            k += 1
            total += math.exp(-rate[source] + k * math.log(rate[source]) - math.lgamma(k + 1))
        out.append(k)
    return out
