"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import exp

import regex

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def mix_targets(sizes: dict, weights=(5, 2, 1), most=3):
    """sizes: source -> words. Shares the total by weight and reshares what is above ``most`` times a source's size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        now = {s: left * weight[s] / total for s in free}
        over = [s for s in free if now[s] > most * sizes[s]]
        if not over:
            return fixed | now
        for s in over:
            fixed[s] = float(most * sizes[s])
            left -= fixed[s]
        if len(fixed) == len(order):
            return fixed


def base_counts(text):
    text = text or ""
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def base_failed(counts):
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def chat_digest(turns):
    """turns: (role, text) in order -> n_turns, turns_sha256, loss_chars, loss_sha256."""
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def crc(text):
    return zlib.crc32((text or "").encode())


def removed_bytes(docs, length=100):
    """docs: [(doc_id, text)] -> doc_id -> set of removed byte places, by looking at every string of that length."""
    first, out = {}, {d: set() for d, _ in docs}
    for d, text in sorted(docs, key=lambda x: x[0]):
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            if first.setdefault(raw[i : i + length], (d, i)) < (d, i):
                out[d].update(range(i, i + length))
    return out


def splitmix(h):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ h >> shift) * factor % 2**64
    return h


def simhash(text, shingle=3, mix=lambda h: h):
    import xxhash

    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(w)
    if not w:
        return 0
    s = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    ones = Counter()
    for x in s:
        h = mix(xxhash.xxh64_intdigest(x.encode(), 42))
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(s))


def link_components(prints: dict, most=3):
    """doc_id -> smallest doc_id reachable over pairs of fingerprints that differ in at most ``most`` bits."""
    ids, root = sorted(prints), {d: d for d in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def mix_taken(rows, target: dict, budget, most=3):
    """rows: (source, order within the source, size), one a document; target: source -> words. Copies of each row that
    the queue takes: passes of all sources by virtual finish time, up to the budget."""
    sources = sorted((s for s in target if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in target else [])
    queue = []
    for rank, s in enumerate(sources):
        mine = sorted((i for i, r in enumerate(rows) if r[0] == s), key=lambda i: rows[i][1])
        whole, upto = sum(rows[i][2] for i in mine), 0
        for nth, i in enumerate(mine):
            upto += rows[i][2]
            if rows[i][2] and target[s]:
                queue += [((e * whole + upto) / target[s], rank, nth, e, i) for e in range(most) if e < target[s] / whole]
    taken, words = [0] * len(rows), 0
    for *_, i in sorted(queue):
        words += rows[i][2]
        if words > budget:
            break
        taken[i] += 1
    return taken


def quality_statistics(text):
    """The statistics of a text by name, as the rules of the classifier see them."""
    t = text or ""
    n = lambda p: len(regex.findall(p, t))
    words = max(1.0, float(len(words_ := words_of(t))))
    raw = {
        "symbols": n(r"[#$%&*|<>~^=_{}\[\]\\]"), "bangs": n(r"[!?]{2}"), "upper": n(r"\p{Lu}{2,}"), "digits": n(r"[0-9]+"), "stops": n(r"[.!?](?=[ \t-\r]|$)"), "commas": n(r"[,;:]"),
        "breaks": t.count("\n"), "links": n(r"://|www\.|@"), "long": n(r"[^ \t-\r]{16,}"), "vocabulary": len(set(re.split(r"[\x20\x09-\x0D]+", t.lower()))), "chars": len(t),
    }
    return {"words": float(len(words_)), **{f"{k}_per_word": v / words for k, v in raw.items()}, "repeated_lines": 1 - len(set(t.split("\n"))) / (raw["breaks"] + 1)}


words_of = words


def quality_score(text, bias, rules):
    """rules: (weight, ((statistic, left, threshold), ...)); left is <=."""
    s = quality_statistics(text)
    z = bias + sum(w for w, rule in rules if all((s[n] <= t) if left else (s[n] > t) for n, left, t in rule))
    return 1 / (1 + exp(-z)) if z > -700 else 0.0


def template(text, units):
    """Plain words of a text, and the same with placeholders: # a number, @ a name inside a sentence, ~ a unit after a number."""
    t, plain, out = text or "", [], []
    for m in regex.finditer(r"[\p{L}\p{N}]+", t):
        w, at = m[0], m.start()
        name = regex.match(r"\p{Lu}\p{Ll}", t[at : at + 2]) and at >= 2 and t[at - 1] == " " and regex.match(r"[\p{Ll}\p{N},;]", t[at - 2])
        plain.append(w.lower())
        number = regex.match(r"\p{N}", w)
        out.append("@" if name else "#" if number else "~" if out and out[-1] == "#" and w.lower() in units else w.lower())
    return plain, out


def windows(text, units, size=5):
    """place -> (keys, plain words, template words) of each window of a text."""
    p, q = template(text, units)
    plain_at, found = [i for i, w in enumerate(q) if w not in "#@~"], {}
    for i in range(max(1, len(q) - size + 1) if q else 0):
        a, b = tuple(p[i : i + size]), tuple(q[i : i + size])
        held = sum(w in "#@~" for w in b)
        keys = {("plain", a)}
        if 1 <= held <= size - 2:
            keys.add(("template", b))
        if held > size - 2:
            after, before = [j for j in plain_at if j >= i][:2], [j for j in plain_at if j <= i + size - 1][-2:]
            keys |= {(side, b, *((j - i, q[j]) for j in two)) for side, two in (("after", after), ("before", before)) if len(two) == 2}
        found[i] = keys, a, b
    return found


def contaminated(docs, items, units, least=0.8):
    """docs, items: key -> text. (doc, item) -> share of the item's windows that consistent diagonals cover."""
    out, ours = {}, {k: windows(t, units) for k, t in items.items()}
    for d, text in docs.items():
        theirs = windows(text, units)
        by_key = defaultdict(list)
        for i, (keys, *_) in theirs.items():
            for k in keys:
                by_key[k].append(i)
        for item, mine in ours.items():
            lines = defaultdict(lambda: (set(), set()))
            for j, (keys, plain, slots) in mine.items():
                for i in {i for k in keys for i in by_key.get(k, ())}:
                    places, pairs = lines[i - j]
                    places.add(j)
                    if any(w in "#@~" for w in theirs[i][2]):
                        pairs |= {(s, x, y) for s, x, y in zip(slots, plain, theirs[i][1]) if s in "#@~"}
            good = [places for places, pairs in lines.values() if len({(s, x) for s, x, _ in pairs}) == len(pairs)]
            share = len(set().union(*good)) / len(mine) if mine else 0
            if share >= least:
                out[d, item] = share
    return out


def propagate(docs, shards, quota, gh, ph, free):
    """docs: (size, text, part, label). (text, part) -> shard, by rounds of votes under quotas; gh, ph: hashes that order
    texts and parts; free(text, round): a number that picks a shard where no vote counts."""
    size, first = Counter(), defaultdict(list)
    for n, g, p, label in docs:
        size[g, p] += n
        first[g, p].append((label, n))
    label, left, full, r = dict.fromkeys(size), [quota] * shards, set(), 0
    while True:
        room = [s for s in range(shards) if left[s] > 0 and s not in full]
        if not room:
            return label, left
        votes = defaultdict(Counter)
        for (g, p), n in size.items():
            for s, m in [(label[g, p], n)] if label[g, p] is not None else first[g, p]:
                votes[g][s] += m
        want = {}
        for g, p in size:
            order = sorted(votes[g], key=lambda s: (-votes[g][s], (s + gh[g]) % shards))
            want[g, p] = next((s for s in order if s in room or s == label[g, p]), None)
            if want[g, p] is None:
                want[g, p] = room[free(g, r) % len(room)]
        upto, moves, closed = Counter(), {}, set()
        for x in sorted((x for x in size if want[x] != label[x]), key=lambda x: (gh[x[0]], ph[x], size[x])):
            upto[want[x]] += size[x]
            if upto[want[x]] <= left[want[x]]:
                moves[x] = want[x]
            else:
                closed.add(want[x])
        for x, s in moves.items():
            left[s] -= size[x]
            if label[x] is not None:
                left[label[x]] += size[x]
            label[x] = s
        if not moves and closed <= full:
            return label, left
        full |= closed
        r += 1


def similar_roots(rows, least=0.8, most=6, reach=12, both=24, agree=2):
    """Smallest id of each group joined by equal words and by candidates that are similar enough: all within ``most`` bits,
    and those within ``reach`` and ``both`` that have ``agree`` of ``most + agree`` blocks of bits in common."""
    import xxhash

    cut = [64 * i // (most + agree) for i in range(most + agree + 1)]

    def candidate(a, b):
        x = prints[a] ^ prints[b]
        if x.bit_count() <= most:
            return True
        same = sum(x >> lo & ((1 << (hi - lo)) - 1) == 0 for lo, hi in zip(cut, cut[1:]))
        return same >= agree and x.bit_count() <= reach and x.bit_count() + (seconds[a] ^ seconds[b]).bit_count() <= both

    def shingles(t):
        w = t.split()
        return {xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))} if w else set()

    prints = {d: simhash(t) for d, t in rows.items()}
    seconds = {d: simhash(t, mix=splitmix) for d, t in rows.items()}
    text = {d: b" ".join((t or "").encode().lower().split()) for d, t in rows.items()}
    sets = {d: shingles(t) for d, t in text.items()}
    root = {d: d for d in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            near = candidate(a, b) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) > 0
            if near or text[a] == text[b]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(d) for d in ids}
