"""Tokenizer alignment, hard negatives and SentencePiece against the libraries and plain versions, and on odd input."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import align, negatives, pieces
from quarry.session import ship

from ..conftest import SF

ODD = [
    None, "", " ", "   ", "▁", "a\0b", "  x y ", "\t\n a", "x▁y", "<s> <unk> </s><0x41>", "é 힣 ﷺ ﬁne　ｆｕｌｌ  ", "<|endoftext|> a<|endoftext|>", "x   \n y \n\nz　 q", " a", "a  b", "a \n b",
    "\U0001f600\U0001f600 \U0001f468‍\U0001f469", "x " * 50, "\n", "a" * 3000, " " * 300 + "b", "it's 's don't", "①②  ½ â ガ か゛", "´a ´", "lorem ipsum " * 4000,
]


def fuzz(alphabet, n=1500, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    ship(spark)
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def raw(text):
    return (text or "").encode()


# 13 SentencePiece


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def model(rules=b""):
    """The public vocabulary with the rules of NFKC and white space in place of none, and then `rules`."""
    given = open(pieces.default_path(), "rb").read()
    made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    spec = next(v for n, v, *_ in pieces.fields(made) if n == 3) + rules
    return b"".join(given[s:e] for n, _, s, e in pieces.fields(given) if n != 3) + b"\x1a" + varint(len(spec)) + spec


@pytest.mark.parametrize("name", ["identity", "nfkc", "nfkc, white space stays"])
def test_pieces_like_the_library(texts, name):
    own = open(pieces.default_path(), "rb").read() if name == "identity" else model(b"" if name == "nfkc" else bytes([3 << 3, 0, 4 << 3, 0]))
    library, found = sentencepiece.SentencePieceProcessor(model_proto=own), pieces.Pieces(own)
    data = ODD + fuzz("aé ▁　ﱞ´゛か①́ ﬁ\n") + texts[: 100 if name != "identity" else None]
    ids, starts, ends, counts = found.encode([raw(t) for t in data])
    decoded, at = found.decode(ids, counts), 0
    for text, n, shown in zip(data, counts.tolist(), decoded, strict=True):
        wanted = library.encode(text or "", return_type="proto").pieces
        mine = slice(at, at + n)
        assert (ids[mine].tolist(), starts[mine].tolist(), ends[mine].tolist()) == ([p.id for p in wanted], [p.begin for p in wanted], [p.end for p in wanted]), text
        assert shown == library.decode(ids[mine].tolist())
        at += n
    rng = random.Random(1)
    for _ in range(500):
        some = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(32000), 28705]) for _ in range(rng.randrange(8))]
        assert found.decode(np.array(some, np.int64), np.array([len(some)])) == [library.decode(some)]


def test_character_map():
    found = pieces.Pieces(model())
    text = "x ﬁ①　か゛"
    done, source = found.normalise(text.encode())
    assert done.decode() == "▁x▁fi1▁か▁\u3099"
    assert [text.encode()[a:b].decode() for a, b in ((source[7], source[9]), (source[9], source[10]))] == ["ﬁ", "①"]
    assert source[-1] == len(text.encode())


def test_pieces_columns(spark):
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in enumerate(ODD)] + [(3, ODD[3], 5, "s"), (None, "a b", 5, "s")], "doc_id long, text string, ids int, starts string")
    found = pieces.decode(pieces.encode(docs, pieces.default_path()), pieces.default_path())
    assert found.columns == ["doc_id", "text", "ids", "starts", "ends", "decoded"]
    rows = found.collect()
    assert len(rows) == len(ODD) + 2
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
        assert all(a <= b for a, b in zip(r.starts, r.ends, strict=True))
    assert pieces.encode(docs.limit(0), pieces.default_path()).collect() == []
    with pytest.raises(Exception, match="does not have"):
        pieces.decode(spark.createDataFrame([([40000],)], "ids array<int>"), pieces.default_path()).collect()


def test_sentencepiece_query(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    found = {r.doc_id: r for r in pieces.op13_sentencepiece(spark, SF).collect()}
    given = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(given)
    for r in given:
        ids = library.encode(r.text or "")
        own = found[r.doc_id]
        assert (own.n_tokens, own.ids_sha256, own.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert own.covered_bytes == len(raw(r.text))


# 11 alignment

A = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    """Tokens, links and groups of a text, from the libraries' whole encodings and their byte offsets."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    a.encode_special_tokens = True
    letters = align._byte_letters()

    def work(text):
        if not text:
            return 0, 0, [], ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == raw(" " + text):
            return 0, 0, [], ""
        at_a, at_b = ({int(e): i + 1 for i, e in enumerate(np.cumsum([len(x) for x in own]))} for own in (bytes_a, bytes_b))
        i = j = 0
        links, groups = [], []
        for end in sorted(at_a.keys() & at_b.keys()):
            groups.append(",".join(map(str, ids_a[i : at_a[end]])) + "|" + ",".join(map(str, ids_b[j : at_b[end]])))
            i, j = at_a[end], at_b[end]
            links.append((ids_a[i - 1], ids_b[j - 1]))
        return len(ids_a), len(ids_b), links, ";".join(groups)

    return work


def test_components():
    rng = random.Random(4)
    for _ in range(300):
        total = rng.randrange(1, 40)
        ends = [np.array(sorted({*rng.sample(range(1, total + 1), rng.randrange(total)), total})) for _ in range(2)]
        last_a, last_b = align.components(*ends)
        cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        for own, found in zip(ends, (last_a, last_b), strict=True):
            assert ends[0][found].tolist() == [next(c for c in cuts if c >= e) for e in own.tolist()]


def test_alignment_of_texts(texts, plain):
    found = align.Aligner(A, pieces.default_path())
    data = ODD + fuzz("ab   \n\t　 é\U0001f600'1.<▁") + texts
    for first in range(0, len(data), 300):
        some = data[first : first + 300]
        n_a, n_b, flat, links, groups = found.of([raw(t) for t in some])
        at = 0
        for i, n in enumerate(links.tolist()):
            assert (n_a[i], n_b[i], list(zip(flat[0][at : at + n].tolist(), flat[1][at : at + n].tolist(), strict=True)), groups[i].decode()) == plain(some[i]), some[i]
            at += n


def wanted(rows, plain):
    """The query's rows for (doc_id, text), each link looked at by itself."""
    made = [(i, *plain(t)) for i, t in rows]
    counts = collections.Counter(link for *_, links, _ in made for link in links)
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(
        (str(i), n_a, n_b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if n_a else "")
        for i, n_a, n_b, links, groups in made
    )


def test_alignment_query(spark, plain):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((str(r.doc_id), *r[1:]) for r in align.op11_token_alignment(spark, SF).collect()) == wanted(given, plain)


@pytest.mark.parametrize("hot", [0, 5, 1 << 20])
def test_alignment_counts(spark, plain, hot):
    ship(spark)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a  b"), (None, "don't"), (7, "lorem ipsum")]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n_best int, groups string")
    linked = align.align(docs, A, pieces.default_path())
    found = align.score_links(linked, align.link_counts(linked), hot)
    assert found.columns == ["doc_id", "text", "n_a", "n_b", "groups", "n_best", "count_sum"]
    mine = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in found.collect())
    assert mine == [(i, a, b, best, total, digest) for i, a, b, _, _, best, total, digest in wanted(rows, plain)]
    assert align.score_links(linked.limit(0), align.link_counts(linked.limit(0)), hot).collect() == []


# 12 hard negatives


def by_hand(rows, every=100, positives=5, negatives_=10, low=30, high=90):
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = [(-sum(int(x) * int(y) for x, y in zip(v, w, strict=False)), i, other == label) for i, other, w in rows if i != a]
        for score, p, _ in sorted((s for s in scored if s[2]))[:positives]:
            fit = sorted(s for s in scored if not s[2] and low * -score <= 100 * -s[0] <= high * -score)[:negatives_]
            out += [(a, p, k + 1, n, -score, -s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows):
    ship(spark)
    df = spark.createDataFrame(rows, "vec_id long, label long, vector array<double>").repartition(3)
    return sorted(map(tuple, negatives.hard_negatives(df).collect()))


@pytest.mark.parametrize("size", [1, 300, 1 << 25, 1 << 40, 1 << 53])
def test_negatives_by_hand(spark, size):
    rng = random.Random(size)
    rows = [(i, rng.randrange(3), [float(rng.randint(-size, size)) for _ in range(6)]) for i in range(0, 1500, 5)]
    found, expected = mined(spark, rows), by_hand(rows)
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    assert found == sorted((*e[:4], clip(e[4]), clip(e[5])) for e in expected) and found


def test_negatives_ties_blocks_lengths(spark, monkeypatch):
    rows = [(i, i % 2, [1.0, 2.0] if i % 3 else [1.0, 1.0, 5.0][: i % 4]) for i in range(0, 900)] + [(100, 0, [1.0, 2.0])] * 2
    expected = by_hand(rows)
    assert mined(spark, rows) == expected
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 64)
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    assert mined(spark, rows) == expected
    assert mined(spark, [(1, 1, [1.0])]) == [] == mined(spark, [(100, 1, [1.0])])
    assert mined(spark, []) == []


def test_residue_products():
    rng = np.random.default_rng(2)
    for size, columns in ((1, 3), (1000, 64), (1 << 26, 700)):
        left, right = (rng.integers(-size, size + 1, (20, columns)).astype(np.float64) for _ in range(2))
        bound = size * size * columns
        mods = negatives.primes(bound, columns)
        found = negatives.remaindered([negatives.product(negatives.residues(left, p), negatives.residues(right, p), p) for p in mods], mods, bound)
        exact = left.astype(np.int64).astype(object) @ right.astype(np.int64).astype(object).T
        assert (found == exact).all()
        assert len(mods) > 1 or size == 1


def test_negatives_usable(spark):
    ship(spark)
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [0.5, -0.001]), (2, None, [1.0]), (3, 1, None), (4, 1, [nan]), (5, 1, [1.0, -inf]), (6, 1, [None]), (None, 1, [1.0]), (14, 9, [1.0]), (-7, 3, []), (8, 2, [3e38])]
    found = {r.vec_id: (r.label, r.vector) for r in negatives.usable(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    assert found == {1: (1, [128.0, -1.0]), 14: (0, [256.0]), -7: (4, []), 8: (2, [float(np.float32(3e38)) * 256])}


def test_negatives_query(spark, duck):
    found = negatives.op12_hard_negatives(spark, SF)
    result = duck.execute(negatives.OP12_SQL)
    assert [d[0] for d in result.description] == found.columns
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(result.fetchall()) and rows
