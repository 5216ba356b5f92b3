"""Plain versions of the operators, over lists of rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict


def lower(s):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), s)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_duplicates(docs, n, percent=80):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text)."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    of = defaultdict(list)
    for i, s in sets:
        of[s].append(i)
    own = [s for s in of if s]
    up = list(range(len(own)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    having = defaultdict(set)
    for k, s in enumerate(own):
        for g in s:
            having[g].add(k)
    for k, s in enumerate(own):
        for j, both in Counter(j for g in s for j in having[g] if j < k).items():
            if 100 * both >= percent * (len(s) + len(own[j]) - both):
                up[find(k)] = find(j)
    least = {}
    for k, s in enumerate(own):
        least[find(k)] = min([*of[s], least.get(find(k), math.inf)])
    place = {s: k for k, s in enumerate(own)}
    comp = lambda i, s: least[find(place[s])] if s else i
    return sorted((i, len(s), comp(i, s), comp(i, s) == i) for i, s in sets)


def top_k(rows, k=5):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, x) in enumerate(fine):
        if i % 50 == 0:
            scores = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), j) for b, (j, y) in enumerate(fine) if a != b)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def repeats(docs, length=400):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)"""
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[p : p + length] for _, t in raw for p in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(docs, items, size=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)"""
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    lengths, out = {len(w) for w in windows}, []
    for i, t in docs:
        w, found = words(t), set()
        hit = [False] * len(w)
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit[k : k + n] = [True] * n
                    found |= own
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out)


KINDS = (("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))


def base_secrets(text):
    """(start, kind number, end, kind)"""
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(KINDS) for m in re.finditer(p, text or "") if len(m.group(g)) >= least]
    return sorted(found)


def secrets(docs):
    """(doc_id, n_assign, n_access, n_hex, base_sha256)"""
    out = []
    for i, t in docs:
        found = base_secrets(t)
        n = Counter(f[3] for f in found)
        out.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in found).encode()).hexdigest()))
    return sorted(out)


RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def url_rule(url):
    """(host, path, rule, verdict of the rule)"""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = lower(host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def page_rank(links, seeds, damping=0.85, rounds=30, tolerance=1e-6):
    """links: {(source, target): n}; seeds: {host: weight}"""
    total = sum(seeds.values()) or 1
    base = {h: w / total for h, w in seeds.items() if w}
    out = Counter()
    for (s, _), n in links.items():
        out[s] += n
    rank = dict(base)
    for _ in range(rounds if links else 0):
        step = defaultdict(float, {h: (1 - damping) * b for h, b in base.items()})
        for (s, t), n in links.items():
            if s in rank:
                step[t] += damping * rank[s] * n / out[s]
        moved = sum(abs(step.get(h, 0) - rank.get(h, 0)) for h in {*step, *rank})
        rank = dict(step)
        if moved < tolerance:
            break
    return rank


def judge_urls(pages):
    """(page_id, host, path, rule, verdict) of rows (page_id, url, html)"""
    own, links, good, bad = [], Counter(), Counter(), Counter()
    for i, url, html in pages:
        host, path, rule, verdict = url_rule(url)
        own.append((i, host, path, rule, verdict))
        good[host] += verdict == "allow"
        bad[host] += verdict == "block"
        for link in re.findall(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'>\s]+)""", html or ""):
            target = url_rule("http:" + link if link.startswith("//") else link)[0]
            if host and target and host != target:
                links[host, target] += 1
    trust = page_rank(links, good)
    distrust = page_rank({(t, s): n for (s, t), n in links.items()}, bad)
    blocked = {h for h, d in distrust.items() if d > 0 and d >= trust.get(h, 0)}
    return sorted(((i, h, p, r, v or ("block" if h in blocked else "allow")) for i, h, p, r, v in own), key=repr)
