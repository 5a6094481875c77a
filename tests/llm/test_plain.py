"""Template decontamination and toxicity against plain versions that go through everything."""

import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import templates, toxicity
from quarry.session import ship

NUMBER, UNIT, NAME = "#number", "#unit", "#name"
UNIT_WORDS = "|".join(sorted((u for u in templates.UNITS if u.isalpha()), key=lambda u: (-len(u), u)))
JOINED = re.compile(rf"\b(\d[\d.,]*)({UNIT_WORDS})\b", re.ASCII)


def streams_of(text):
    """Per way a list of (first word, what windows compare, kind or None, value)."""
    words = [templates._facts(w) for w in JOINED.sub(r"\1 \2", text).split()]
    n, token = len(words), [w[0] for w in words]
    number, name, ends = ([bool(w[1] & bit) for w in words] for bit in (1, 2, 4))
    start = [i == 0 or ends[i - 1] for i in range(n)]
    kind = [NUMBER if number[i] else UNIT if i and number[i - 1] and token[i] in templates.UNITS else None for i in range(n)]
    article = [token[i] in templates.DETERMINERS and not ends[i] for i in range(n)]
    noun = [i > 0 and (article[i - 1] or (i > 1 and article[i - 2] and not name[i - 1] and not ends[i - 1])) for i in range(n)]
    kept = []
    for i in range(n):
        near = [j for j in range(max(0, i - templates.AROUND), min(n, i + templates.AROUND + 1)) if name[j] and not start[j]]
        nouns = sum(noun[j] for j in near)
        beside = (i > 0 and name[i - 1] and not ends[i - 1]) or (i + 1 < n and name[i + 1] and not ends[i])
        kept.append(name[i] and (beside or not (nouns >= 2 and 2 * nouns >= len(near))))
    inner = {token[i] for i in range(n) if kept[i] and not start[i]}
    sure = [kept[i] and (not start[i] or token[i] in inner) for i in range(n)]
    out = []
    for kinds in ([None] * n, [k or (NAME if s else None) for k, s in zip(kind, sure, strict=True)], [k or (NAME if s else None) for k, s in zip(kind, kept, strict=True)]):
        stream = []
        for i in range(n):
            if stream and kinds[i] in (NUMBER, NAME) and kinds[i] == kinds[i - 1] and not ends[i - 1]:
                at, what, k, value = stream[-1]
                stream[-1] = (at, what, k, value + " " + token[i])
            else:
                stream.append((i, kinds[i] or token[i], kinds[i], token[i]))
        out.append(stream)
    return out


def windows_of(stream, size):
    found = [(i, stream[i : i + size]) for i in range(len(stream) - size + 1)] if size else []
    return [(i, own) for i, own in found if sum(s[2] is None for s in own) >= min(templates.LITERAL, size)]


def agreeing(pairs):
    """The most windows that one mapping of slots holds, taken in order, beginning with each that no choice had."""
    best, had = 0, set()
    for begin in range(len(pairs)):
        if begin in had:
            continue
        mapping, own = set(), []
        for w in [begin] + [i for i in range(len(pairs)) if i != begin]:
            new = mapping | set(pairs[w])
            if len({(k, a) for k, a, _ in new}) == len(new) == len({(k, b) for k, _, b in new}):
                mapping = new
                own.append(w)
        had.update(own)
        best = max(best, len(own))
    return best


def longest(hits):
    """The most hits that rise in both places, by comparing all."""
    hits, chain = sorted(hits), {}
    for h in hits:
        before = [chain[g] for g in hits if g[0] < h[0] and g[1] < h[1]]
        chain[h] = max(before, key=len, default=[]) + [h]
    return max(chain.values(), key=len)


def coverage_of(item, text):
    items, texts = streams_of(item), streams_of(text)
    sizes = [min(templates.WINDOW, len(s)) for s in items]
    seen, counted = set(), set()
    for i, own in windows_of(items[1], sizes[1]):
        if (key := tuple(s[1] for s in own)) not in seen:
            seen.add(key)
            counted.add(own[0][0])
    met = {}
    for way in range(3):
        for _, a in windows_of(items[way], sizes[way]):
            for _, b in windows_of(texts[way], sizes[way]):
                if a[0][0] in counted and [s[1] for s in a] == [s[1] for s in b]:
                    met.setdefault((a[0][0], b[0][0]), None if way == 0 else [(x[2], x[3], y[3]) for x, y in zip(a, b, strict=True) if x[2]])
    groups = {}
    for hit in met:
        groups.setdefault(hit[1] - hit[0], []).append(hit)
    tried, near = [sorted(g) for g in groups.values()], []
    for shift in sorted(groups):
        if near and shift - near[-1] > templates.WINDOW:
            tried.append(longest([h for s in near for h in groups[s]]))
            near = []
        near.append(shift)
    tried += [longest([h for s in near for h in groups[s]])] if near else []
    best, least = 0, templates.COVERAGE * len(counted)
    for hits in tried:
        slots = [met[h] for h in hits if met[h] is not None]
        agree = agreeing(slots)
        if agree >= templates.AGREEING * len(slots):
            best = max(best, len(hits) - len(slots) + agree)
    return best / len(counted) if counted and best >= least else 0.0


LANGUAGES = {
    "en": "we saw that the old road near a small river was closed and then many people went home with their friends because it rained all day while some stayed".split(),
    "de": "gestern hat der Hund über die Straße den Ball gesehen und dann das Haus neben dem Baum gefunden weil ein Kind im Garten mit der Katze war".split(),
    "fr": "nous avons vu que la vieille route près du fleuve était fermée puis les gens sont rentrés avec leurs amis parce qu'il pleuvait toute une journée".split(),
    "es": "vimos que el viejo camino cerca del río estaba cerrado y luego muchas personas volvieron con sus amigos porque llovía todo aquel día entero".split(),
}
NAMES, UNITS = ["Anna", "Ben", "Carla", "Diego", "Eva Maier", "Jean Paul Roux"], ["kg", "km", "litres", "hours"]


def filled(rng, frame):
    names, numbers = rng.sample(NAMES, 3), rng.sample(range(2, 900), 3)
    unit = rng.choice(UNITS)
    return " ".join(frame).format(*names, x=f"{numbers[0]} {unit}", y=f"{numbers[1]}{unit}", z=numbers[2])


def cases(seed):
    rng = random.Random(seed)
    items, texts = [], ["", "7 8 9", "der", "haus Anna und"]
    for k in range(16):
        words = LANGUAGES[rng.choice(sorted(LANGUAGES))]
        frame = [rng.choice(["{0}", "{1}", "{2}", "{x}", "{y}", "{z}"]) if rng.random() < 0.25 else rng.choice(words) + rng.choice(["", "", "", "", ",", ".", "?"]) for _ in range(rng.choice([5, 9, 14, 25, 40]))]
        items.append((k, filled(rng, frame)))
        for _ in range(4):
            own = list(frame)
            for _ in range(rng.choice([0, 0, 1, 3, 6])):  # words that go, come or are others
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], [own[at], rng.choice(words)], [rng.choice(words)], ["{1}"]])
            around = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(2)]
            texts.append(f"{around[0]}. {filled(rng, own)} {around[1]}")
    return items, texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_templates_against_all_windows(spark, seed):
    """Items and coverage as comparing all windows of all items with all of all texts gives them, in four languages."""
    ship(spark)
    items, texts = cases(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = templates.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r.doc_id: (r["items"], r.coverage) for r in rows}
    want = {}
    for n, text in enumerate(texts):
        shares = {k: c for k, item in items if (c := coverage_of(item, text))}
        want[n] = (sorted(shares), max(shares.values(), default=0.0))
    assert found == want
    assert 16 <= sum(bool(own) for own, _ in want.values()) < len(texts)


def plain_features(text):
    out = set()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        out.add("=" + word)
        out.update(word[i : i + 5] for i in range(len(word)) if len(word[i : i + 5]) == 5)
        out.update("^" + word[:k] for k in (4, 5) if len(word) >= 4)
    return out


def descended(x, y):
    """Weights and bias of the ridge's least loss: Newton with halved steps until nothing moves."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.array([0.3] * (x.shape[1] - 1) + [1e-3])

    def loss(w):
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * w * w))

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (p - y) + penalty * w
        if np.abs(gradient).max() < 1e-9:
            break
        step, rate = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), gradient), 1.0
        while loss(w - rate * step) > loss(w) and rate > 1e-6:
            rate /= 2
        w = w - rate * step
    return w[:-1], w[-1]


def plain_chain(docs, labels, most):
    """(probability of low quality, of toxic) by id: features counted, chosen and fitted in plain loops, the chain out of fold."""
    own = sorted(i for i in labels if i in docs)
    features = {i: plain_features(docs[i]) for i in docs}
    fold = {i: zlib.crc32(str(i).encode()) % toxicity.FOLDS for i in own}
    everywhere = {}
    for i in own:
        for f in features[i]:
            everywhere[f] = everywhere.get(f, 0) + 1

    def chosen(ids):
        out = []
        for c in range(2):
            share = sum(labels[i][c] for i in ids) / max(1, len(ids))
            scores = {}
            for f in everywhere:
                n = sum(f in features[i] for i in ids)
                if n >= 3:
                    off = sum(labels[i][c] for i in ids if f in features[i]) - n * share
                    scores[f] = off * off / (n * max(share * (1 - share), 1e-9))
            out += sorted(scores, key=lambda f: (-scores[f], f))[:most]
        return sorted(set(out))

    def rows(ids, names, earlier):
        return np.array([[float(f in features[i]) for f in names] + toxicity.shapes(docs[i]) + earlier[i] for i in ids])

    def odds(x, w, bias):
        return 1 / (1 + np.exp(-(x @ w + bias)))

    outside = {f: chosen([i for i in own if fold[i] != f]) for f in range(toxicity.FOLDS)}
    every = chosen(own)
    trained, judged = {i: [] for i in own}, {i: [] for i in docs}
    for c in range(2):
        y = {i: float(labels[i][c]) for i in own}
        w, bias = descended(rows(own, every, trained), np.array([y[i] for i in own]))
        now = dict(zip(docs, odds(rows(list(docs), every, judged), w, bias), strict=True))
        later = {}
        for f in range(toxicity.FOLDS):
            seen, held = [i for i in own if fold[i] != f], [i for i in own if fold[i] == f]
            v, b = descended(rows(seen, outside[f], trained), np.array([y[i] for i in seen]))
            later |= dict(zip(held, odds(rows(held, outside[f], trained), v, b), strict=True))
        for i in docs:
            judged[i] = judged[i] + [now[i]]
        for i in own:
            trained[i] = trained[i] + [later[i]]
    return {i: tuple(p) if docs[i].strip() else (0.0, 0.0) for i, p in judged.items()}


def test_toxicity_against_a_plain_fit(spark, monkeypatch):
    """Every text's probabilities as a plain chain has them."""
    ship(spark)
    monkeypatch.setattr(toxicity, "PER_CATEGORY", 12)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.choice([2, 4, 5, 7, 9]))) for _ in range(40)]
    docs, labels = {}, {}
    for i in range(150):
        bad, junk = rng.random() < 0.3, rng.random() < 0.3
        text = [rng.choice(words) + ("%%" if junk and rng.random() < 0.5 else "") for _ in range(rng.randrange(5, 30))]
        if bad and rng.random() < 0.9:
            text[0] = rng.choice(["Snarfle", "grobnik", "snarfling"])
        docs[i] = "" if i == 149 else " ".join(text)
        if i % 3:
            labels[i] = (junk, bad)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, 0 if junk else 1, int(bad)) for i, (junk, bad) in labels.items()], "doc_id long, quality int, toxic int")
    found = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in toxicity.toxicity(frame, marks).collect()}
    want = plain_chain(docs, labels, 12)
    assert found.keys() == want.keys()
    assert max(abs(a - b) for i in want for a, b in zip(found[i], want[i], strict=True)) < 1e-3
