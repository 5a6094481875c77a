"""Benchmark decontamination by templates.

A token is a word between white space without its outer punctuation, in lower case. Its template is the token, or a
typed placeholder: a number; a unit, if it follows a number; a name, if it has a capital within a sentence, or at a
sentence's start if the text has it within one elsewhere. Where the capitals around follow determiners, as nouns do in
German, a capital alone is no name: two side by side are. Names side by side are one placeholder, and so are numbers.
Windows of WINDOW template tokens of benchmark items are hash-joined with those of texts; a window needs LITERAL tokens
that are no placeholders. Windows are met in three ways: as they are, with placeholders, and with placeholders also for
every capital at a sentence's start. Windows that meet in order, at shifts of which each is near the next, are put
together, and their slots are compared: within a type, equal values of the item must stand where equal values of the
text stand, and unequal ones where unequal ones stand. Windows of the best consistent set found (see `consistent`)
count, and literal copies always; an item is in a text if these are at least COVERAGE of the item's windows, and at least
AGREEING of those that met with placeholders. So questions with other numbers, names and units are caught too, also where
numbers are in words and units joined to them, and texts in which one value stands for two of the item's are not.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import ship

from .common import LOWERED, WordFacts, plus, slices, span_codes, table, texts, word_spans

WINDOW, LITERAL, COVERAGE = 8, 3, 0.5
#: Of the windows that meet with placeholders in one alignment so many must agree with one mapping.
AGREEING = 2 / 3
#: Item windows that are broadcast at one time; larger benchmarks are met in blocks, one pass over the texts each.
BLOCK_WINDOWS = 500_000
WORD, NUMBER, UNIT, NAME = range(4)
PLAIN, TEMPLATE, OPEN = range(3)
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg t oz lb lbs gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds ml cl l litre litres liter liters gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "mph kph km/h m/s hz khz mhz ghz v a w kw mw kwh j kj cal kcal k c f °c °f degree degrees percent % "
    "$ € £ usd eur gbp dollar dollars euro euros cent cents bit bits byte bytes kb mb gb tb".split()
)
#: Numbers in words.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
#: Determiners, and prepositions joined to them, of the language that writes nouns with capitals.
DETERMINERS = frozenset(
    "der die das den dem des ein eine einen einem einer eines kein keine keinen keinem keiner mein meine meinen meinem meiner dein deine sein seine seinen seinem "
    "seiner ihr ihre ihren ihrem ihrer unser unsere unseren unserem dieser diese dieses diesen diesem jeder jede jedes jeden jedem im am zum zur vom beim ins ans".split()
)
#: Words to either side that tell whether nouns have capitals there.
AROUND = 24
_OUTER = re.compile(r"^[^\w%°$€£]+|[^\w%°$€£]+$")
_NUMBER = re.compile(r"^[$€£]?[+-]?\d[\d.,:/]*%?$")
_P = np.uint64(0x9E3779B97F4A7C15)
_SIEVE = 20
_PLACES = np.array([0, 0x6E756D626572, 0x756E6974, 0x6E616D65], np.uint64)


_NUMERIC, _NAME, _ENDS = 1, 2, 4
_STOPS = frozenset(".!?:…")
_MARKS = _STOPS | frozenset(",;")


def _facts(word: str) -> tuple[str, int]:
    """The token, and flags: whether it is a number, may be a name, and ends a sentence."""
    if word.isalpha():
        token, ends = word, False
    elif word[-1] in _MARKS and word[:-1].isalpha():
        token, ends = word[:-1], word[-1] in _STOPS
    else:
        token, ends = _OUTER.sub("", word), word.rstrip("\"')]}»”’")[-1:] in _STOPS
    low = token.lower() or word
    name = token[:1].isupper() and (len(token) == 1 or not token.isupper())
    number = low in NUMBER_WORDS if token.isalpha() else _NUMBER.match(low)
    return low, (_NUMERIC if number else 0) | (_NAME if name else 0) | (_ENDS if ends else 0)


def _of_words(words: list[bytes]) -> list[np.ndarray]:
    """Digests of the tokens, and flags."""
    found = [_facts(w.decode("utf-8", "replace")) for w in words]
    tokens = [low.encode("utf-8", "replace") for low, _ in found]
    sizes = np.array([len(t) for t in tokens], np.int64)
    ends = np.cumsum(sizes)
    return [span_codes(np.frombuffer(b"".join(tokens), np.uint8), ends - sizes, ends, LOWERED), np.array([f for _, f in found], np.uint8)]


_LETTER, _CAPITAL, _END, _MARK = (np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".!?:", b".!?:,;"))
_UNIT_DIGESTS = np.sort(_of_words([u.encode() for u in UNITS])[0])
_NUMBER_DIGESTS = np.sort(_of_words([w.encode() for w in NUMBER_WORDS])[0])
_DETERMINER_DIGESTS = np.sort(_of_words([w.encode() for w in DETERMINERS])[0])
#: A number and its unit written as one word.
_JOINED = re.compile(rb"\b(\d[\d.,]*)(" + b"|".join(sorted((u.encode() for u in UNITS if u.isalpha()), reverse=True)) + rb")\b")
_BLANKS = re.compile(rb"\xc2\xa0|\xe2\x80[\x80-\x8a]|\xe3\x80\x80")


class Tokens:
    """The words of texts in a row: where they are, the digests and flags of their tokens, and how many each text has."""

    def __init__(self, data: list[bytes], facts: WordFacts):
        data = [_JOINED.sub(rb"\1 \2", _BLANKS.sub(b" ", t)) for t in data]
        self.raw, self.starts, self.ends, self.counts = word_spans(data)
        n = len(self.starts)
        self.digests, self.flags = np.zeros(n, np.uint64), np.zeros(n, np.uint8)
        if not n:
            return
        # Words of ASCII letters, with one mark after them or none, are done in array operations.
        letters, capitals = (np.add.reduceat(x[self.raw], self.starts, dtype=np.int64) for x in (_LETTER, _CAPITAL))
        sizes = self.ends - self.starts
        last = self.raw[self.ends - 1]
        plain = (letters > 0) & ((letters == sizes) | ((letters == sizes - 1) & _MARK[last]))
        at, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        self.digests[at] = span_codes(self.raw, self.starts[at], self.starts[at] + letters[at], LOWERED)
        name = _CAPITAL[self.raw[self.starts[at]]] & ((letters[at] == 1) | (capitals[at] < letters[at]))
        self.flags[at] = _NUMERIC * np.isin(self.digests[at], _NUMBER_DIGESTS) + _NAME * name + _ENDS * _END[last[at]]
        self.digests[rest], self.flags[rest] = facts.of(self.raw, self.starts[rest], self.ends[rest])

    def token(self, i: int) -> str:
        return _facts(self.raw[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace"))[0]


class Stream:
    """Tokens of texts, names and numbers side by side in one: where each begins, its kind, text and template digest."""

    def __init__(self, tokens: Tokens, kinds: np.ndarray, text: np.ndarray, ends: np.ndarray):
        n = len(kinds)
        same = np.zeros(n, bool)
        same[1:] = (kinds[1:] == kinds[:-1]) & ((kinds[1:] == NAME) | (kinds[1:] == NUMBER)) & (text[1:] == text[:-1]) & ~ends[:-1]
        self.at = np.flatnonzero(~same)
        self.stops = np.append(self.at[1:], n)
        self.kinds, self.text = kinds[self.at], text[self.at]
        self.digests = np.where(self.kinds == WORD, tokens.digests[self.at], _PLACES[self.kinds])
        self.tokens = tokens

    def value(self, i: int) -> str:
        return " ".join(self.tokens.token(j) for j in range(self.at[i], self.stops[i]))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Digests of all windows of so many tokens, and which have enough literal ones and are of one text."""
        n = max(0, len(self.digests) - size + 1)
        out, literal = np.full(n, size, np.uint64), np.zeros(n, np.int64)
        for j in range(size):
            out = (out * _P) ^ self.digests[j : j + n]
            out ^= out >> np.uint64(29)
            literal += self.kinds[j : j + n] == WORD
        return out, (literal >= min(LITERAL, size)) & (self.text[:n] == self.text[size - 1 : size - 1 + n])


class Templates:
    """The three streams of texts in a row."""

    def __init__(self, data: list[bytes], facts: WordFacts):
        tokens = Tokens(data, facts)
        digests, n = tokens.digests, len(tokens.digests)
        number, name, ends = ((tokens.flags & bit) > 0 for bit in (_NUMERIC, _NAME, _ENDS))
        firsts = np.cumsum(tokens.counts) - tokens.counts
        first = np.zeros(n, bool)
        first[firsts[firsts < n]] = True
        text = np.repeat(np.arange(len(firsts)), tokens.counts)
        after_number, after_end = np.zeros(n, bool), np.ones(n, bool)
        after_number[1:], after_end[1:] = number[:-1], ends[:-1]
        after_number[first], after_end[first] = False, True
        unit = np.flatnonzero(after_number & ~number)
        other = np.where(number, NUMBER, WORD)
        other[unit[np.isin(digests[unit], _UNIT_DIGESTS)]] = UNIT
        # Capitals of which most around follow a determiner, next to it or with one word between, are nouns.
        within = name & ~after_end
        if within.any():
            determiner = np.isin(digests, _DETERMINER_DIGESTS) & ~ends
            follows = np.zeros(n, bool)
            follows[1:] = determiner[:-1]
            follows[2:] |= determiner[:-2] & ~name[1:-1] & ~ends[1:-1] & ~first[1:-1]
            left = np.maximum(np.arange(n) - AROUND, np.repeat(firsts, tokens.counts))
            right = np.minimum(np.arange(n) + AROUND + 1, np.repeat(firsts + tokens.counts, tokens.counts))
            around, nouns = (np.concatenate([[0], np.cumsum(x)]) for x in (within, within & follows))
            german = (nouns[right] - nouns[left] >= 2) & (2 * (nouns[right] - nouns[left]) >= around[right] - around[left])
            beside = np.zeros(n, bool)
            beside[1:] = name[:-1] & ~ends[:-1] & ~first[1:]
            beside[:-1] |= name[1:] & ~ends[:-1] & ~first[1:]
            name = name & (~german | beside)
        keys = digests ^ ((text.astype(np.uint64) + np.uint64(1)) * _P)
        within = name & ~after_end
        starts = np.flatnonzero(name & after_end)
        named = within.copy()
        named[starts[np.isin(keys[starts], keys[within])]] = True
        self.streams = [Stream(tokens, np.where((other == WORD) & x, NAME, k), text, ends) for x, k in ((np.zeros(n, bool), np.full(n, WORD)), (named, other), (name, other))]


def consistent(pairs: list[list[tuple[int, str, str]]]) -> int:
    """How many windows agree with one mapping of slot values; pairs are each window's (kind, item's value, text's value).

    Windows are taken in order, and the choice is made anew beginning with each window that no choice has had yet; the best counts.
    """

    def chosen(order: list[int]) -> list[int]:
        there: dict[tuple[int, str], str] = {}
        back: dict[tuple[int, str], str] = {}
        out = []
        for w in order:
            there_new, back_new, ok = {}, {}, True
            for kind, a, b in pairs[w]:
                x, y = there_new.get((kind, a), there.get((kind, a), b)), back_new.get((kind, b), back.get((kind, b), a))
                if x != b or y != a:
                    ok = False
                    break
                there_new[kind, a], back_new[kind, b] = b, a
            if ok:
                out.append(w)
                there |= there_new
                back |= back_new
        return out

    best, had = 0, set()
    for start in range(len(pairs)):
        if start not in had:
            own = chosen([start, *(w for w in range(len(pairs)) if w != start)])
            had.update(own)
            best = max(best, len(own))
    return best


def in_order(hits: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The most (item's place, text's place) that rise in both."""
    tails: list[int] = []
    last: list[tuple[int, int]] = []
    before: dict[tuple[int, int], tuple[int, int] | None] = {}
    for i, p in sorted(hits, key=lambda h: (h[0], -h[1])):
        at = bisect_left(tails, p)
        before[i, p] = last[at - 1] if at else None
        tails[at : at + 1], last[at : at + 1] = [p], [(i, p)]
    out, hit = [], last[-1] if last else None
    while hit is not None:
        out.append(hit)
        hit = before[hit]
    return out[::-1]


def alignments(hits: set[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Hits of one shift, and those in order over shifts of which each is at most WINDOW from the next."""
    by_shift: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, p in sorted(hits):
        by_shift[p - i].append((i, p))
    yield from by_shift.values()
    shifts = sorted(by_shift)
    group: list[int] = []
    for n, shift in enumerate(shifts):
        group.append(shift)
        if n + 1 == len(shifts) or shifts[n + 1] - shift > WINDOW:
            if len(group) > 1:
                yield in_order({h for g in group for h in by_shift[g]})
            group = []


def apart(digests: np.ndarray, places: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Which windows to look at (places ascending): of equal ones that overlap again and again, those that stand free of the last one looked at, and the last of all."""
    order = np.lexsort((places, digests))
    d, p, t = digests[order], places[order], text[order]
    over = (d[1:] == d[:-1]) & (p[1:] - p[:-1] < size) & (t[1:] == t[:-1])
    keep = np.ones(len(p), bool)
    if over.any():
        edges = np.diff(np.concatenate([[0], over.astype(np.int8), [0]]))
        for start, stop in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            last = int(p[start])
            for i in range(start + 1, stop):  # the chain's last stays
                if p[i] - last < size:
                    keep[i] = False
                else:
                    last = int(p[i])
    out = np.empty(len(p), bool)
    out[order] = keep
    return out


class Bench:
    """Windows of benchmark items, by their digests."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.streams: list[list[Stream]] = []
        self.sizes: list[list[int]] = []
        self.counts: list[int] = []
        self.by_digest: list[dict[int, list[tuple[int, int]]]] = [defaultdict(list) for _ in range(3)]
        facts = WordFacts(_of_words)
        for k, (_, text) in enumerate(items):
            streams = Templates([text.encode("utf-8", "replace")], facts).streams
            sizes = [min(WINDOW, len(s.digests)) for s in streams]
            found = [s.windows(n) if n else (np.zeros(0, np.uint64), np.zeros(0, bool)) for s, n in zip(streams, sizes, strict=True)]
            # Windows, by their first word. Of equal windows the first counts: a phrase said over and over is said once.
            places = np.flatnonzero(found[TEMPLATE][1])
            counted = set(streams[TEMPLATE].at[places[np.unique(found[TEMPLATE][0][places], return_index=True)[1]]].tolist())
            self.streams.append(streams)
            self.sizes.append(sizes)
            self.counts.append(len(counted))
            for way, (digests, enough) in enumerate(found):
                for i in np.flatnonzero(enough).tolist():
                    if int(streams[way].at[i]) in counted:
                        self.by_digest[way][int(digests[i])].append((k, i))
        self.digests = [np.array(sorted(x), np.uint64) for x in self.by_digest]
        self.sieves = [np.zeros(1 << _SIEVE, bool) for _ in range(3)]
        for sieve, digests in zip(self.sieves, self.digests, strict=True):
            sieve[digests >> np.uint64(64 - _SIEVE)] = True
        self.all_sizes = [sorted({s[way] for s in self.sizes if s[way]}) for way in range(3)]

    def find(self, own: Templates) -> Iterator[tuple[int, int, float]]:
        """(text's number, item's id, coverage) for texts in a row."""
        met: dict[tuple[int, int], dict[tuple[int, int], tuple[int, int, int]]] = defaultdict(dict)
        for way in range(3):  # of the ways in which two windows meet the first counts
            stream = own.streams[way]
            for size in self.all_sizes[way] if len(self.digests[way]) else []:
                digests, enough = stream.windows(size)
                if not len(digests):
                    continue
                maybe = np.flatnonzero(enough & self.sieves[way][digests >> np.uint64(64 - _SIEVE)])
                at = np.minimum(np.searchsorted(self.digests[way], digests[maybe]), len(self.digests[way]) - 1)
                there = maybe[self.digests[way][at] == digests[maybe]]
                for p in there[apart(digests[there], there, stream.text[there], size)].tolist():
                    for k, i in self.by_digest[way][int(digests[p])]:
                        if self.sizes[k][way] == size:
                            met[int(stream.text[p]), k].setdefault((int(self.streams[k][way].at[i]), int(stream.at[p])), (way, i, p))
        for (t, k), hits in met.items():
            least, best = COVERAGE * self.counts[k], 0
            if len({i for i, _ in hits}) < least:
                continue
            for aligned in alignments(set(hits)):
                if len(aligned) < least or len(aligned) <= best:
                    continue
                pairs = []
                for hit in aligned:
                    way, i, p = hits[hit]
                    item, stream = self.streams[k][way], own.streams[way]
                    if way != PLAIN:
                        pairs.append([(int(item.kinds[i + j]), item.value(i + j), stream.value(p + j)) for j in range(self.sizes[k][way]) if item.kinds[i + j] != WORD])
                agree = consistent(pairs)
                if agree >= AGREEING * len(pairs):
                    best = max(best, len(aligned) - len(pairs) + agree)
            if best >= least:
                yield t, self.ids[k], best / self.counts[k]


def blocks_of(benchmark: DataFrame, most: int = BLOCK_WINDOWS) -> Iterator[Bench]:
    """The items in blocks of about so many windows, each small enough to be broadcast."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    windows = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = 1 + windows // most
    for block in range(n):
        yield Bench([(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).orderBy("item_id", "text").collect()])


def decontaminate(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """`docs` with items array<long>, the benchmark items found in each text, and coverage double, the largest share of an item's windows.

    Null and empty texts hold nothing: an empty array and 0.0. Items that are null, empty or without enough literal
    tokens are never found; repeated items count once. Columns of docs with these names are replaced.
    """
    keep = docs.drop("items", "coverage")
    found = None
    names = keep.columns
    for number, bench in enumerate(blocks_of(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            facts = WordFacts(_of_words)
            bench = shared.value
            for part in slices(batches, column, 2 << 20):
                data = texts(part, column)
                items: list[dict[int, float]] = [{} for _ in data]
                if bench.digests[TEMPLATE].size:
                    for t, item, share in bench.find(Templates(data, facts)):
                        items[t][item] = max(share, items[t].get(item, 0))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([sorted(x) for x in items], pa.list_(pa.int64())), pa.array([max(x.values(), default=0.0) for x in items])], [*part.schema.names, "items", "coverage"])

        if number == 0:
            found = keep.mapInArrow(work, plus(keep, "items array<long>, coverage double"))
        else:
            before = found.withColumnsRenamed({"items": "__items", "coverage": "__coverage"})
            found = before.mapInArrow(work, plus(before, "items array<long>, coverage double")).select(*names, F.array_union("__items", "items").alias("items"), F.greatest("__coverage", "coverage").alias("coverage"))
    return found


def op8_template_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, is_contaminated, items and coverage for every document."""
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("is_contaminated"), "items", "coverage")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, as they are."""
    ship(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(F.size("items") == 0).select(*docs.columns)
