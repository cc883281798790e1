"""Operators against plain versions, and awkward tables: nulls, empty and long texts, ties, repeated rows, no rows,
columns with clashing names."""

import collections
import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.llm.common import Workspace, components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("base", T.IntegerType()), T.StructField("id", T.IntegerType())])
LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
TEXTS = {1: None, 2: "", 3: " \n\t ", 4: "One two three", 5: "one TWO three", 6: "a b c d e f g h i j k l m n o p q r s t u v w x y z", 7: "a b c d e f g h i j k l m n o p q r s t u v w x y zz", 8: LONG, 9: LONG + " end", 10: "mail me@example.com or +1 (555) 123-4567, card 4111 1111 1111 1111 at 10.0.0.1\nÉté 😀 x@y.zz", 11: "one two three"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i == 7 else "s" + str(i % 3), None, "clash", 5, 6) for i, t in TEXTS.items()]
    rows += [rows[5], (None, "no id here", None, "s0", 1, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i in (4, 5))) for i in range(1, 12)] + [(None, None, None)], "doc_id bigint, quality int, toxic int")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_near_dups(pairs):
    sets = {i: shingles(t) for i, t in pairs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 100)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(Workspace(spark, "t"), edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[200] == 100


def test_near_dups_awkward(spark, docs, none):
    from karst.llm.near_dups import near_duplicates

    got = near_duplicates(Workspace(spark, "t"), docs).collect()
    assert len(got) == docs.count()
    wanted = brute_near_dups(TEXTS.items())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id)
    assert near_duplicates(Workspace(spark, "t"), none).count() == 0


def test_near_dups_chains_and_crowds(spark):
    """Chains that no star covers, a crowd of near copies, and many texts that share most of a passage."""
    from karst.llm.near_dups import near_duplicates

    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        texts[i] = " ".join(base[: 100 + i // 4] if i % 2 else [*base[i // 3 :]])
    for i in range(60, 140):
        w = list(base[:80])
        for j in rng.choice(80, 2, replace=False):
            w[j] = f"r{i}_{j}"
        texts[i] = " ".join(w)
    passage = [f"p{i}" for i in range(40)]
    for i in range(140, 200):
        texts[i] = " ".join(passage + [f"o{i}_{j}" for j in range(i % 14)])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(Workspace(spark, "t"), df).collect()}
    assert got == brute_near_dups(texts.items())


def test_bbit_estimate(spark):
    from karst.llm.near_dups import Shingles, _packed, estimate, minima

    sets = Shingles()
    words = [f"w{i}" for i in range(400)]
    for share in (0.0, 0.5, 0.9, 1.0):
        a, b = sets.of(" ".join(words)), sets.of(" ".join(words[: int(400 * share)] + [f"v{i}" for i in range(400 - int(400 * share))]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        df = spark.createDataFrame([(_packed(minima(a)).tolist(), _packed(minima(b)).tolist())], "a array<bigint>, b array<bigint>")
        assert df.select(estimate("a", "b").alias("e")).first()["e"] == pytest.approx(true, abs=0.15)


def test_packing(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from karst.llm.packing import pack, sequences

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = pack(Workspace(spark, "t"), docs, path, window=64)
    got = pieces.toPandas()
    library = Tokenizer.from_file(path)
    of = collections.defaultdict(list)
    for r in got.itertuples():
        ids = np.frombuffer(r.ids, "<u2").astype("<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length
        of[r.sequence_id].append((r.offset, r.length))
    for n, found in of.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == 64 or n == max(of)
    for i, text in TEXTS.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        mine = got[got.doc_id == i].sort_values("start").drop_duplicates("start")
        assert b"".join(mine.ids) == np.array(ids, "<u2").tobytes() and set(mine.doc_tokens) == {len(ids)}
    whole = sequences(pieces).toPandas()
    assert whole.n_tokens.sum() == got.length.sum() and (whole.ids.map(len) == 2 * whole.n_tokens).all()
    last = whole.sort_values("sequence_id").iloc[-1]
    assert last.sequence_length in (64, last.n_tokens)
    assert pack(Workspace(spark, "t"), none, path).count() == 0


def test_packing_refuses_tokenizers_that_need_whole_texts():
    import public_tokenizers

    from karst.llm.tokens import check_chunks

    check_chunks(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="chunks in a row"):
        check_chunks(public_tokenizers.path("byte_bpe_50k.json"))


def test_chunk_ids_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from karst.llm.tokens import ChunkIds

    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), ChunkIds(path)
    for text in ["", " ", "<|endoftext|> hi", "don't I'll", "ÀÉß ÿ", "x\x1cy z", "İstanbul ΣΑΣ", "1234.5 &&& a..b", "é  x", 'THE,the. "q"', "ſ K Å", "a×b÷c µm ªº", "a b c", "Ĳ ǅ ﬁ", "!?!? ...x"]:
        assert list(struct.unpack(f"<{len(mine.of(text)) // 2}H", mine.of(text))) == library.encode(text, add_special_tokens=False).ids, text


def test_chunk_ids_of_many_texts_equal_the_library():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from karst.llm.tokens import ChunkIds

    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), ChunkIds(path)
    rng = random.Random(5)
    letters = [*map(chr, range(0x20, 0x7F)), *"aeiourstnlAEIOU  \n\t", *map(chr, range(0xA0, 0x180)), "\0", "\x1c", "\x85", "\u0301", "\u3000", "\u2028", "漢", "🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL "]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)] + [None, "", " ", "ab" * 300, "É" * 50, "!" * 100, "x" * 40, "x" * 41, "7" * 90]
    texts += ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 45))) for _ in range(3000)]
    for part in (texts, texts[3001:3003], texts[:1]):
        got = mine.all(pa.array(part, pa.string()), 2).to_pylist()
        for text, ids in zip(part, got, strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2], text


def test_chunk_ids_take_less_time_than_merging_word_by_word():
    """Distinct words are most of the work on large tables: they are merged side by side."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from karst.llm.tokens import ChunkIds

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(6)
    tries = [["".join(rng.choices("etaoinshrdlu", k=10)) for _ in range(60_000)] for _ in range(4)]  # others each time: no cache helps
    mine, model = ChunkIds(path), Tokenizer.from_file(path).model

    def took(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    alone = min(took(lambda: [[t.id for t in model.tokenize(w)] for w in words]) for words in tries)
    assert min(took(lambda: mine.of(" ".join(words))) for words in tries) < alone


def test_tokenize_in_small_blocks(spark, docs):
    """Blocks of text are cut by bytes; offsets of a task run on over them."""
    import public_tokenizers

    from karst.llm.packing import tokenize

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, cut = (tokenize(docs, path, text_bytes=n).orderBy("part", "local_start").collect() for n in (10**7, 30))
    assert whole == cut and len(cut) == docs.count()


def test_token_counts(spark, docs, none):
    import public_tokenizers
    import sentencepiece

    from karst.llm.token_counts import Lengths, token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    lengths = Lengths(path, {})
    for text in ["", " ", "  ", "a ", " a", "a  b", "a   ", "\n", " \n", "<s> x </s>", "é́ 　x", "a\tb  \n c ", "▁a ▁", "x▁ y", " ▁ ▁▁"]:
        assert lengths.of(text) == len(library.encode(text)), repr(text)
    got = token_counts(docs, path, limit=100).collect()
    assert len(got) == docs.count() and token_counts(none, path).count() == 0
    for r in got:
        text = TEXTS.get(r.doc_id) or ""
        if r.doc_id:
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(library.encode(text)), len(library.encode(text)) > 100)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_distances():
    from karst.llm.automaton import FuzzyLexicon, Term

    rng = np.random.default_rng(3)
    terms = [Term("".join(rng.choice(list("abc"), n)), bool(i % 2)) for i, n in enumerate((3, 5, 6, 7, 9, 10))]
    lexicon = FuzzyLexicon(terms)
    for _ in range(3000):
        t = terms[rng.integers(len(terms))].text
        w = list(t)
        for _ in range(rng.integers(4)):
            i = rng.integers(len(w)) if w else 0
            w[i : i + rng.integers(2)] = list(rng.choice(list("abcd"), rng.integers(2)))
        w = "".join(w)
        # the first letter stands: distances between what follows it
        far = [min((lev(w[1:n], t.text[1:]) for n in ([len(w)] if t.whole else range(1, len(w) + 1))), default=99) if w[:1] == t.text[:1] else 99 for t in terms]
        fits = [(d, i + 1) for i, (d, t) in enumerate(zip(far, terms)) if d <= t.edits]
        number, edits = lexicon.look(w)
        assert (number > 0) == bool(fits) and (not fits or edits == min(fits)[0]), (w, terms, fits, number, edits)


def test_automaton_with_edits_anywhere():
    """The whole Levenshtein distance, to a word or to any of its beginnings, small tables or not."""
    from karst.llm.automaton import FuzzyLexicon, Term

    rng = np.random.default_rng(4)
    terms = [Term("".join(rng.choice(list("abc"), n)), bool(i % 2)) for i, n in enumerate((3, 5, 6, 7, 9, 10))]
    small = FuzzyLexicon(terms, anywhere=True)
    small.MOST_PAIRS = 300
    lexicon = FuzzyLexicon(terms, anywhere=True)
    for _ in range(3000):
        w = list(terms[rng.integers(len(terms))].text)
        for _ in range(rng.integers(4)):
            i = rng.integers(len(w)) * rng.integers(2) if w else 0
            w[i : i + rng.integers(2)] = list(rng.choice(list("abcd"), rng.integers(2)))
        w = "".join(w)
        far = [min(lev(w[:n], t.text) for n in ([len(w)] if t.whole else range(len(w) + 1))) for t in terms]
        fits = [d for d, t in zip(far, terms) if d <= t.edits]
        number, edits = lexicon.look(w)
        assert (number > 0) == bool(fits) and (not fits or edits == min(fits)), (w, terms, fits, number, edits)
        assert small.look(w) == (number, edits)


def test_terms_misspelt_in_their_first_letter():
    from karst.llm import toxicity as tox

    matcher = tox.Matcher([(tox.Term("idiot", True), 1.0), (tox.Term("scoundrel", False), 1.0)])
    for text in ("you xdiot", "you 1diot", "you @diot", "you diot", "you $coundrels", "you **oundrel", "you zscoundrel"):
        assert [h[0] < 0 for h in matcher.hits(text)] == [True], text
    assert [h[0] for h in matcher.hits("@idiot *idiot*")] == [1, 1] and not matcher.hits("you radio")


def test_toxicity(spark, docs, labels, none):
    from karst.llm import toxicity as tox

    rng = np.random.default_rng(5)
    plain = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "te") for b in ("ra", "ne", "so") for c in ("n", "l", "st")]
    rows, marks = [], []
    for i in range(600):
        w = list(rng.choice(plain, 40))
        bad = i % 6 == 0
        for _ in range(3 * bad):
            w.insert(rng.integers(len(w)), str(rng.choice(["scoundrel", "nitwit", "blockhead"])))
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    df, known = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    model = tox.train(df, known)
    assert {t.text for t, _ in model.terms} >= {"scoundrel", "nitwit", "blockhead"}
    got = {r.doc_id: r.score for r in tox.score(df, model).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == (i % 6 == 0) for i in out) and out
    asked = spark.createDataFrame([(1, "you nitwlt and scoundral"), (2, 'he said "nitwit" is a word'), (3, None)], "doc_id bigint, text string")
    matcher = tox.Matcher(model.terms, model.ordinary)
    assert [h[0] < 0 for h in matcher.hits("you nitwlt and scoundral")] == [True, True]
    assert [h[1] for h in matcher.hits('he said "nitwit" is a word')] == [1.0] and [h[1] for h in matcher.hits("you nitwit")] == [0.0]
    assert all(0 <= r.score <= 1 for r in tox.score(asked, model).collect())
    # misspelling is seen through and quotation is told from abuse: each turns the decision
    around = " ".join(plain[:36])
    cases = {"plain": "you {} and {} " + around, "misspelt": "you {} and {} " + around, "quoted": 'he said "{}" and she wrote "{}" ' + around}
    words = {"plain": ("nitwit", "scoundrel"), "misspelt": ("nitwlt", "scoundral"), "quoted": ("nitwit", "scoundrel")}
    rows = [(i, cases[k].format(*words[k])) for i, k in enumerate(cases)] + [(3, "you and " + around)]
    got = [r.predicted for r in tox.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).withColumn("predicted", F.col("score") >= tox.THRESHOLD).orderBy("doc_id").collect()]
    assert got == [True, True, False, False]
    scored = tox.score(docs, tox.train(docs, labels))
    assert scored.count() == docs.count() and scored.where("score is null").count() == 0
    assert tox.score(none, tox.train(none, labels)).count() == 0


def test_scores_by_plain_loops(spark):
    """Hits by the distance to every term, contexts word by word, and the logistic of their features."""
    from karst.llm import toxicity as tox

    terms = [(tox.Term("nitwit", True), 2.0), (tox.Term("scoundrel", False), 3.0), (tox.Term("ape", True), 1.5)]
    weights = [-3.0, 1.0, 0.5, 0.7, 0.9, 0.4, -0.2]
    texts = ["", "no such thing", "you nitwit", 'they said "you utter nitwit" today', "Nitwlt scoundrelly xcoundrel ape apes", '"nitwit', 'she wrote of a nitwit" and an ape', "«nitwit» " + "a " * 20 + "nitwit said nitwit ordinarx", "nit wit " * 10 + "scoundrel ape nitwit nitwit"]
    ordinary = frozenset(["ordinarx", "xcoundrel"])

    def features(text):
        low = text.lower()
        tokens = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W_](?:[\w*@$]*[^\W_])?", low)]
        plain, fuzzy = [], []
        for i, (w, start, end) in enumerate(tokens):
            options = []
            for n, (t, strength) in enumerate(terms):
                far = min(lev(w[:m], t.text) for m in ([len(w)] if t.whole else range(len(w) + 1)))
                if far <= t.edits:
                    options.append((far, n))
            if not options or (min(options)[0] and w in ordinary):
                continue
            far, n = min(options)
            near = tokens[max(0, i - 8) : i + 9]
            between = lambda at: sum(min(at, start) <= s < max(at, start) and s != start for _, s, _ in tokens)
            lo, hi = near[0][1], near[-1][2] if i + 8 < len(tokens) else len(low)
            opens, closes = [m.start() for m in re.finditer(r"(?:^|(?<=\s))[\"“«„‘]|[“«„]", low[:start]) if m.start() >= lo - 1], [m.start() for m in re.finditer(r"[\"”»’](?=\s|[.,;:!?]|$)|[”»]", low) if end <= m.start() <= hi]
            shut = [m.start() for m in re.finditer(r"[\"”»’](?=\s|[.,;:!?]|$)|[”»]", low[:start]) if m.start() >= lo - 1]
            opened = 1 - between(max(opens)) / 9 if opens and max(opens) > max(shut, default=-1) else 0.0
            closed = 1 - between(min(closes)) / 9 if closes else 0.0
            report = max((1 - (abs(j - i) - 1) / 9 for j in range(max(0, i - 8), min(len(tokens), i + 9)) if tokens[j][0] in tox.REPORTS), default=0.0)
            c = 1 - (1 - opened * closed) * (1 - report * max(opened, closed))
            (fuzzy if far else plain).append((n, c))
        live = lambda hits: [1 - c for _, c in hits]
        strength = sum(terms[n][1] * max(1 - c for m, c in plain if m == n) for n in {n for n, _ in plain})
        return [max(live(plain), default=0.0), strength**0.5, math.log1p(sum(live(plain))), max(live(fuzzy), default=0.0), math.log1p(sum(live(fuzzy))), math.log1p(sum(c for _, c in plain + fuzzy))]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in tox.score(df, tox.Model(terms, ordinary, weights)).collect()}
    for i, text in enumerate(texts):
        z = weights[0] + sum(a * b for a, b in zip(weights[1:], features(text)))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z))), text


def test_lexicon_needs_significance():
    """Forms in a few toxic documents that chance explains are no terms; those it doesn't explain are."""
    from karst.llm import toxicity as tox

    assert not tox.significant(3, 0, 0.1, 1000) and tox.significant(8, 0, 0.1, 1000)
    assert not tox.significant(8, 40, 0.1, 1000) and tox.significant(60, 2, 0.1, 1000)


def test_vectors(spark):
    from karst.llm.vector_dups import near_duplicate_vectors

    rng = np.random.default_rng(7)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(16)
        for _ in range(1 if c % 3 else 60 if c == 0 else 4):
            rows.append((len(rows), (centre + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist(), c % 2))
    same = rows[5]
    n = len(rows)
    rows += [(n + i, same[1], same[2]) for i in range(5)]
    odd = [None, [], [0.0] * 16, [1.0, None], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    rows += [(n + 100 + i, v, 1) for i, v in enumerate(odd)] + [(n + 200, same[1], None), (None, same[1], same[2]), rows[3]]
    schema = "vec_id bigint, embedding array<float>, label int, n string, v string"
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema).repartition(3)
    got = near_duplicate_vectors(Workspace(spark, "t"), df).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v, float), lab) for i, v, lab in rows[: n + 5]] + [(rows[3][0], np.array(rows[3][1], float), rows[3][2])]
    for r in got:
        if r.vec_id is not None and r.vec_id < n + 5:
            v, lab = next((v, lab) for i, v, lab in good if i == r.vec_id)
            links = sum(lab == k and v @ u / math.sqrt((v @ v) * (u @ u)) >= 0.98 for _, u, k in good) - 1
            assert r.n_links == links or r.n_links >= 0.9 * links
            assert r.kept == (r.component_id == r.vec_id)
        elif r.vec_id is not None and r.vec_id != n + 106:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert near_duplicate_vectors(Workspace(spark, "t"), df.where("false")).count() == 0


def test_vectors_of_dense_groups_side_by_side(spark):
    """Groups whose members fill each other's lists are joined by their cross links; groups farther apart aren't."""
    from karst.llm.vector_dups import near_duplicate_vectors

    rng = np.random.default_rng(3)
    base = np.linalg.qr(rng.standard_normal((32, 32)))[0]
    turned = lambda i, degrees: math.cos(math.radians(degrees)) * base[i] + math.sin(math.radians(degrees)) * base[i + 1]
    rows, wanted = [], {}
    for i, (degrees, label) in enumerate([((0, 10), 1), ((0, 10, 20), 2), ((0, 25), 3)]):
        for d in degrees:
            for _ in range(40):
                rows.append((len(rows), (turned(4 * i, d) + 0.001 * rng.standard_normal(32)).astype(np.float32).tolist(), label))
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
    for i in range(len(rows)):
        if i not in wanted:
            reach, todo = {i}, [i]
            while todo:
                new = set(np.flatnonzero(linked[todo.pop()]).tolist()) - reach
                reach |= new
                todo += new
            wanted |= {j: min(reach) for j in reach}
    got = near_duplicate_vectors(Workspace(spark, "t"), spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(linked[i].sum()), wanted[i]) for i in wanted}
    assert len(set(wanted.values())) == 4


def test_audit_counts_vectors(spark):
    """A group with nearly all links doesn't hide that every pair was missed."""
    from karst.llm.vector_dups import audit

    rng = np.random.default_rng(5)
    group = [(i, (np.eye(32)[0] + 0.001 * rng.standard_normal(32)).tolist()) for i in range(100)]
    pairs = [(100 + i, (np.eye(32)[1 + i // 2] + 0.001 * rng.standard_normal(32)).tolist()) for i in range(20)]
    nodes = spark.createDataFrame([(i, 1, 0, v) for i, v in group + pairs], "id bigint, copies bigint, room bigint, v array<double>")
    links = [(i, 99) for i, _ in group]
    assert audit(nodes, spark.createDataFrame(links, "id bigint, n bigint"), 0.98) == 0
    links += [(i, 1) for i, _ in pairs]
    assert audit(nodes, spark.createDataFrame(links, "id bigint, n bigint"), 0.98) == 1


def test_pii(spark, docs, none):
    from karst.llm import pii

    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    def plain(text):
        out = []
        for k, (kind, p) in enumerate(kinds):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                    out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        return ",".join(x for *_, x in sorted(out))

    cases = ["a@b@c.d", "a@b.c_d@e.f", "x@y..z a@b.c.", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.255", "+1 (555) 123-4567 .", "4111 1111 1111 1111", "12 3 4-5", "é a@é.b q@w.e", "+1" + "(" * 20 + "2", "😀 a@b.c 😀 1.2.3.4", "a" * 20000 + "@", "a@b" + ".c" * 20000, "1 " * 20000, "+15551234567 1.1.1.1 +1.1.1.1.1.1.1.1.1.1", LONG]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = pii.personal_data(Workspace(spark, "t"), df).select("doc_id", pii.spelled("base").alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: plain(c) for i, c in enumerate(cases)}
    out = pii.personal_data(Workspace(spark, "t"), docs)
    assert out.count() == docs.count() and pii.personal_data(Workspace(spark, "t"), none).count() == 0
    clean = pii.sanitised(out).where("doc_id = 10").first()
    assert clean.text == "mail [EMAIL] or [PHONE], card [CARD] at [IP]\nÉté 😀 [EMAIL]"
    assert hashlib.sha256(plain(TEXTS[10]).encode()).hexdigest() == out.where("doc_id = 10").select(F.sha2(pii.spelled("base"), 256).alias("h")).first().h


def test_disclosing_terms(spark):
    """A nickname that always stands with an address, or on the line above it, discloses it, also where the address is
    missing; counts by plain loops agree. Terms next to phones become the class of what they reveal."""
    from karst.llm import pii

    rows = [(i, f"line number {i}\nthe falconer wrote from jo@ex.org about item{i} today") for i in range(6)]
    rows += [(10, "we met the falconer at home"), (11, "the item was sent today"), *[(20 + i, f"other lines about the weather {i}") for i in range(6000)]]
    rows += [(9400 + i, f"notes of day {'y' * (i + 1)}\n\nGwendolyn Fairweather\n+1 555 123 4567") for i in range(2)] + [(9500, "ask Gwendolyn about it"), (9501, None), (9502, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.personal_data(Workspace(spark, "t"), df)
    by = {r.doc_id: r for r in pii.sanitised(found).collect()}
    assert "falconer" not in by[10].text and by[25].text == dict(rows)[25]
    assert by[9500].text == "ask [PHONE HOLDER] about it" and by[9400].text.endswith("[PHONE HOLDER] [PHONE HOLDER]\n[PHONE]")
    entity = re.compile(r"jo@ex\.org|\+1 555 123 4567")
    contexts = set()
    for _, t in rows:
        lines = [None, *[x for x in (t or "").split("\n") if x.strip()], None]
        contexts |= {tuple(lines[i - 1 : i + 2]) for i in range(1, len(lines) - 1)}
    held = {c: {m for x in c if x for m in entity.findall(x)} for c in contexts}
    terms = {c: set(re.findall(r"[^\W\d_]{3,}", entity.sub(" ", c[1]).lower())) for c in contexts}
    c_e, c_t, c_te = collections.Counter(e for c in contexts for e in held[c]), collections.Counter(t for c in contexts for t in terms[c]), collections.Counter((t, e) for c in contexts for t in terms[c] for e in held[c])
    ratio = {k: 1 - math.log2((c_t[k[0]] + pii.PRIOR) / n) / math.log2(len(contexts) / c_e[k[1]]) for k, n in c_te.items() if n >= pii.LEAST_CONTEXTS}
    wanted = {t: max(r for (u, _), r in ratio.items() if u == t) for (t, _), r in ratio.items() if r >= pii.GENERALISE}
    got = {r.term: r.ratio for r in pii.revealing_terms(Workspace(spark, "t"), df)[0].collect()}
    assert got == pytest.approx(wanted) and {"falconer", "gwendolyn", "fairweather"} <= set(got)


def test_replacing_many_spans(spark):
    """Texts with many matches, beyond the length of a piece, and overlapping spans, against plain slicing."""
    from karst.llm import pii

    text = " ".join(f"é{i}😀 u{i}@ex{i}.org 10.0.{i % 256}.{i % 250} +1.1.1.{i % 9}.555.123.45" for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, "no match"), (3, "")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pii._with_base(df).select("*", pii._replaced(F.col("text"), F.col("base"), lambda x: F.concat(F.lit("<"), x["k"].cast("string"), F.lit(">"))).alias("out")).collect()}
    out, p = [], 0
    for s, k, e, t in rows[1].base:
        assert text[s:e] == t
        if s >= p:
            out.append(text[p:s] + f"<{k}>")
        p = max(p, e)
    assert rows[1].out == "".join(out) + text[p:] and len(rows[1].base) > 6000 and rows[2].out == "no match" and rows[3].out == ""


def plain_rules(x):
    w = WORD.findall(x)
    seen, dup = set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_quality(spark, docs, labels, none):
    from karst.llm.quality import quality

    more = {50: "a b c d e f g h " * 9, 51: "x\nx\n\n \nx y\nx", 52: "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0 a s d f g h j k l # & <|>", 53: "q " * 25}
    extra = spark.createDataFrame(list(more.items()), "doc_id bigint, text string")
    got = quality(docs.select("doc_id", "text", "score", "base").unionByName(extra, allowMissingColumns=True), labels.select("doc_id")).collect()
    assert len(got) == docs.count() + len(more)
    for r in got:
        if r.doc_id:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules((TEXTS | more)[r.doc_id] or ""), r.doc_id
            assert r.kept == (not r.base_failed and r.score >= -0.25)
    assert quality(none, labels.select("doc_id")).count() == 0
    assert {r.score for r in quality(docs, labels.where("false").select("doc_id")).collect()} == {0.0}


def test_quality_score_is_the_mean_log_ratio(spark):
    from karst.llm import quality as q

    texts = {1: "red apple pie", 2: "red apple tart", 3: "### $$$ ###"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    good = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    ratios = q.log_ratios(df, good, n=64)
    grams = {r.doc_id: [g for g in r.grams if g >= 0] for r in q._grams(df, 64).collect()}
    raw, trusted = collections.Counter(g for v in grams.values() for g in v), collections.Counter(g for i in (1, 2) for g in grams[i])
    n_raw, n_good = sum(raw.values()), sum(trusted.values())
    a, b = 0.02 * n_good / 64, 0.02 * n_raw / 64
    wanted = [math.log((trusted[g] + a) / (n_good + 64 * a)) - math.log((raw[g] + b) / (n_raw + 64 * b)) for g in range(64)]
    assert ratios == pytest.approx([1e6 * w for w in wanted], abs=1)
    got = {r.doc_id: r.score for r in q.quality(df, good, n=64).collect()}
    assert got == pytest.approx({i: sum(ratios[g] for g in v) / len(v) / 1e6 for i, v in grams.items()})
    assert got[3] < -0.25 < got[1]


def test_languages(spark):
    from karst.llm.language import host_of, identify

    talk = {"aa": "kara mito sela kara nuve", "bb": "wyx qzz wrr qwy zzx"}
    labelled = spark.createDataFrame([(i, " ".join(list(talk[x].split()) * 5), x) for i, x in enumerate(["aa", "bb"] * 10)] + [(99, None, "aa"), (98, "x", None)], "doc_id bigint, text string, lang string")
    page = lambda text, lang=None: f"<html{f' lang={lang}' if lang else ''}><body><article><p>{text}</p></article></body></html>"
    rows = [(i, f"http://h.{x}site.org/p{i}", page(talk[x], x)) for i, x in enumerate(["aa", "bb"] * 8)]
    rows += [(50, "http://h.aasite.org/empty", page("")), (51, "http://new.example/bb/x", page("")), (52, None, None), (53, "http://h.bbsite.org/", page(talk["aa"], "bb")), (54, "http://[bad", page("", "aa")), rows[0]]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in identify(Workspace(spark, "t"), pages, labelled).collect()}
    assert all(got[i].lang == ("aa", "bb")[i % 2] for i in range(16))
    assert got[50].lang == "aa" and got[51].address == "bb" and got[52].lang in talk and got[53].lang == "aa" and got[54].lang == "aa"
    assert all(0 < r.confidence <= 1 for r in got.values())
    assert identify(Workspace(spark, "t"), pages, labelled).count() == len(rows)
    assert identify(Workspace(spark, "t"), pages.where("false"), labelled).count() == 0
    assert {r.lang for r in identify(Workspace(spark, "t"), pages, labelled.where("false")).collect()} == {None}
    assert host_of("HTTP://WWW.Ex.org:80/de-AT/x") == ("www.ex.org", "de")


def test_posterior_by_plain_loops(spark):
    """Text, declared language, address and host prior fused by hand give each page's language and confidence."""
    from karst.llm import language as lg

    rng = np.random.default_rng(11)
    words = {x: ["".join(rng.choice(list(a), int(rng.integers(3, 8)))) for _ in range(30)] for x, a in {"aa": "abcdeo", "bb": "fghijo", "cc": "aeioug"}.items()}
    labelled = spark.createDataFrame([(i, " ".join(rng.choice(words[x], 20)), x) for i, x in enumerate(["aa", "bb", "cc"] * 8)], "doc_id bigint, text string, lang string")
    rows, told = [], []
    for i in range(60):
        x = ("aa", "bb", "cc")[int(rng.integers(3))]
        mark = x if rng.random() < 0.6 else ("aa", "zz", None)[int(rng.integers(3))]
        host = f"h{int(rng.integers(3))}.site{int(rng.integers(2))}.{x if rng.random() < 0.4 else 'org'}"
        path = "/bb/p" if rng.random() < 0.2 else "/p"
        text = " ".join(rng.choice(words[x if rng.random() < 0.7 else "cc"], int(rng.integers(0, 12))))
        rows.append((i, f"http://{host}{path}{i}", f"<html{f' lang={mark}' if mark else ''}><body><article><p>{text}</p></article></body></html>"))
        named = "bb" if path == "/bb/p" else host[-2:] if host[-2:] in words else None
        told.append((text, mark, host, named))
    got = {r.page_id: r for r in lg.identify(Workspace(spark, "t"), spark.createDataFrame(rows, "page_id bigint, url string, html string"), labelled).collect()}
    names, logs = lg.fit_text_model(labelled)
    z = []
    for text, *_ in told:
        grams = [zlib.crc32(f"^{w}$"[i : i + 3].encode("utf-32-le")) % lg.BUCKETS for w in text.split() for i in range(len(w))]
        z.append(logs[:, grams].sum(axis=1) * min(1.0, lg.MOST_EVIDENCE / len(grams)) if grams else np.zeros(3))
    post = np.array([np.exp(v - v.max()) / np.exp(v - v.max()).sum() for v in z])

    def mark_log(which):
        values = [*names, "other"]
        of = [None if t[which] is None else t[which] if t[which] in names else "other" for t in told]
        cell = {v: sum((post[i] for i in range(60) if of[i] == v), np.zeros(3)) + lg.MARK_PAGES for v in values}
        total = sum(cell.values())
        return [np.log(cell[v] / total) if v else np.zeros(3) for v in of]

    declared, named = mark_log(1), mark_log(3)
    levels = [lambda h: "", lambda h: h.split(".")[-1], lambda h: ".".join(h.split(".")[-2:]), lambda h: h]
    for i in range(60):
        p = np.full(3, 1 / 3)
        for level in levels:
            others = np.maximum(0, sum((post[j] for j in range(60) if level(told[j][2]) == level(told[i][2])), np.zeros(3)) - post[i])
            p = (others + lg.PRIOR_PAGES * p) / (others.sum() + lg.PRIOR_PAGES)
        total = z[i] + np.log(p) + declared[i] + named[i]
        share = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert got[i].confidence == pytest.approx(share.max(), abs=1e-4) and (got[i].lang == names[int(share.argmax())] or np.sort(share)[-2] > 0.499)
    assert any(got[i].lang != got[i].text_lang for i in range(60))


def test_declared_language_anywhere_and_all_languages(spark):
    from karst.llm.extraction import parsed
    from karst.llm.language import fit_text_model

    long = "x " * 40_000
    assert parsed(f"<!-- {long} <html lang=zz> --><html lang='de-AT'>").declared == "de"
    assert parsed(f"<html><script>'<html lang=zz>'{long}</script><meta content=fr http-equiv=Content-Language>").declared == "fr"
    assert parsed("<html data-lang=zz xml:lang=es>").declared == "es" and parsed(None).declared is None
    codes = [f"{a}{b}" for a in "abcdefghij" for b in "abcdefgh"]
    rows = [(i, f"w{x} q{x}", x) for i, x in enumerate(codes)]
    assert fit_text_model(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))[0] == codes


@pytest.mark.parametrize(
    "html, wanted",
    [
        (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<article><p>a &lt; b &amp;amp; c&nbsp;d</p></article>", "a < b &amp; c d"),
        ('<body><nav>menu</nav><div class="comments">c</div><article><h1>T</h1><p>Some text <b>he</b>re<aside>no</aside> tail</p><ul><li>one<li>two</ul><section id="comments"><p>hi</p></section></article><div id="cookie-notice">x</div><footer>f</footer>', "T\nSome text here\ntail\none\ntwo"),
        ("<script>var a='<p>x</p>';</script><style>p{}</style><!-- c --><main><p>body   of\n text</p></main>", "body of text"),
        ('<header>h</header><div class="readable-content"><p>Long enough paragraph of the page itself.</p></div><form><p>sign up</p></form>', "Long enough paragraph of the page itself."),
        ("<article><p>" + "x" * 100_000, "x" * 100_000), ("<article><p>cut off <b", "cut off"), ("<nav><a>only</a></nav>", ""),
    ],
)
def test_main_text(html, wanted):
    from karst.llm.extraction import main_text

    assert main_text(html) == wanted


@pytest.mark.parametrize(
    "html, wanted",
    [
        ('<div class="content-sidebar-wrap"><main><p>The article itself.</p></main><div class="sidebar">links</div></div>', "The article itself."),
        ('<div class="has-sidebar"><article><p>The article itself.</p></article></div><div class="share">tell others</div>', "The article itself."),
        ('<div class="with-ads"><p>A long paragraph of text that is the page.</p><div class="ads"><a>buy</a></div></div>', "A long paragraph of text that is the page."),
        ('<main><p>Short.</p><div class="legal-text"><p>A long paragraph of text that is most of the page.</p></div></main>', "Short.\nA long paragraph of text that is most of the page."),
        ('<article><p>Short text.</p><div class="comments"><article>A long comment, longer than all of the article.</article></div></article>', "Short text."),
        ('<div class="no-sidebar"><article><p>The article itself.</p></article></div>', "The article itself."),
        ("<html><head><title>t</title><meta charset=utf-8><body><article><p>No end of the head.</p></article>", "No end of the head."),
        ('<form action="/"><nav>menu</nav><article><p>A page that is a form.</p></article><input></form>', "A page that is a form."),
        ('<article><div class="article-header"><h1>Headline</h1></div><p>The article itself.</p></article>', "Headline\nThe article itself."),
        ("<article><p>where a<b then c</p><p>more</p></article>", "where a<b then c\nmore"),
        ("<article><p>" + "<b>x " * 3000 + "</article>", " ".join("x" * 3000)),
        ('<article><p>The article itself.</p></article><div class="related"><article>Another one</article></div>', "The article itself."),
    ],
)
def test_main_text_in_marked_wrappers(html, wanted):
    from karst.llm.extraction import main_text

    assert main_text(html) == wanted


def test_clusters_decide_what_is_a_menu(monkeypatch):
    """A run of links in an article goes, a link between paragraphs stays; without the smoothed ratios it wouldn't."""
    from karst.llm import extraction

    menu = "".join(f"<li><a href=/{i}>Topic {i}</a></li>" for i in range(8))
    html = f'<article><p>First paragraph of the article.</p><p><a href=/x>Only a link</a></p><p>Second paragraph of it.</p><p>Third one.</p><ul>{menu}</ul></article>'
    wanted = "First paragraph of the article.\nOnly a link\nSecond paragraph of it.\nThird one."
    assert extraction.main_text(html) == wanted
    monkeypatch.setattr(extraction, "smooth", lambda values, *_: [1e9] * len(values))
    assert extraction.main_text(html) != wanted
    monkeypatch.setattr(extraction, "smooth", lambda values, *_: list(values))
    assert "Only a link" not in extraction.main_text(html)


def test_ratios_smoothing_and_clusters_by_plain_loops():
    """Pages without article or main elements, against ratio, smoothing and clustering written out."""
    from karst.llm import extraction

    rng = np.random.default_rng(9)
    for _ in range(60):
        lines = [" ".join(["word"] * int(rng.integers(1, 60))) if rng.random() < 0.5 else "go" for _ in range(int(rng.integers(3, 25)))]
        tags = [int(rng.integers(0, 5)) for _ in lines]
        html = "".join(f"<p>{'<i></i>' * t}{x}</p>" for x, t in zip(lines, tags))
        ratio = [len(x) / (2 + 2 * t) for x, t in zip(lines, tags)]
        smoothed = []
        for i in range(len(ratio)):
            w = {j: math.exp(-((i - j) ** 2) / 2) for j in range(max(0, i - 2), min(len(ratio), i + 3))}
            smoothed.append(sum(ratio[j] * v for j, v in w.items()) / sum(w.values()))
        cut = min(np.mean(smoothed), np.std(smoothed))
        chosen = [i for i, r in enumerate(smoothed) if r >= cut - 1e-9]
        assert extraction.main_text(html) == "\n".join(lines[chosen[0] : chosen[-1] + 1])


def test_extraction(spark):
    from karst.llm.extraction import extract, smooth

    df = spark.createDataFrame([(1, "u", "<p>a b</p>", "clash", 3), (1, "u", "<p>a b</p>", "clash", 3), (None, None, None, None, None)], "page_id bigint, url string, html string, text string, n_chars int")
    got = extract(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "a b", 3), (1, "a b", 3)]
    assert extract(df.where("false")).count() == 0
    assert smooth([5.0] * 7) == pytest.approx([5.0] * 7)


def test_quotas_of_large_nodes_are_hypergeometric():
    """Weights against exact probabilities, draws against those and numpy's, and moments beyond numpy's range."""
    from karst.llm.mixing import _log_weight, draw_large, split_quota

    rng = np.random.default_rng(6)
    for left, right, k in ((30, 50, 20), (7, 1000, 500), (400, 3, 100)):
        xs = np.arange(max(0, k - right), min(k, left) + 1)
        exact = np.array([math.comb(left, x) * math.comb(right, k - x) / math.comb(left + right, k) for x in xs.tolist()])
        full = [np.full(len(xs), float(v)) for v in (left, right, k)]
        mine = np.exp(_log_weight(xs.astype(float), *full))
        assert mine / mine.sum() == pytest.approx(exact, rel=1e-6)
        n = 40_000
        got = np.bincount(draw_large(*[np.full(n, v) for v in (left, right, k)], rng) - xs[0], minlength=len(xs))
        many = exact * n >= 10
        assert ((got - exact * n)[many] ** 2 / (exact * n)[many]).sum() < many.sum() + 6 * math.sqrt(2 * many.sum() + 1)
    left, right, k = 4_000_000_000_000, 1_000_000_000_000, 10_000_000
    got = np.array([split_quota(np.array([left, right]), k, np.random.default_rng(i)) for i in range(2000)])
    n, p = left + right, left / (left + right)
    sd = math.sqrt(k * p * (1 - p) * (n - k) / (n - 1))
    assert (got.sum(axis=1) == k).all() and abs(got[:, 0].mean() - k * p) < 5 * sd / math.sqrt(2000) and 0.9 < got[:, 0].std() / sd < 1.1


def test_mix_of_repeated_rows(spark, monkeypatch):
    """Equal rows, rows that share an id and rows without one are drawn each by itself, and the mix has the words that
    were counted; a tree of more than one stretch gives the same totals."""
    from karst.llm import mixing

    monkeypatch.setattr(mixing, "LEVELS", 2)
    text = lambda i, n: " ".join(f"w{i}_{j}" for j in range(n))
    rows = [(1, text(1, 700), "a", 1)] * 2 + [(1, text(2, 900), "a", 2), (None, text(3, 1300), "b", None), (None, text(4, 40), "b", None), (None, None, None, None), (7, text(5, 3000), None, 1)] + [(None, text(6, 600), "b", None)] * 3
    rows += [(100 + i, text(i, 300), "c", i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score int")
    got = mixing.mix(Workspace(spark, "t"), df).collect()
    out = mixing.mixed_documents(Workspace(spark, "t"), df).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    taken, emitted = collections.Counter(), collections.Counter()
    for r in got:
        taken[r.doc_id, r.source] += r.taken
    for r in out:
        emitted[r.doc_id, r.source] += len(WORD.findall(r.text or ""))
    assert taken == emitted
    of = {r.source: math.floor(r.target + 1e-9) for r in got}
    for s, n in of.items():
        assert sum(r.taken for r in got if r.source == s) == n


def test_mixing(spark, docs, none):
    from karst.llm.mixing import mix, mixed_documents, split_quota

    rng = np.random.default_rng(2)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(int(rng.integers(0, 2000)))), None if i % 7 == 0 else f"s{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix(Workspace(spark, "t"), df).toPandas()
    again = mix(Workspace(spark, "t"), df.repartition(5)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    sizes = collections.defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values())
    full, target = set(), {}
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and level * weight[s] > 3 * sizes[s]}
        full |= over
        if not over:
            break
    target = {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in order}
    for s in order:
        mine = got[got.source.isna()] if s is None else got[got.source == s]
        assert mine.target.iloc[0] == pytest.approx(target[s]) and mine.taken.sum() == math.floor(mine.target.iloc[0] + 1e-9) and set(mine.source_size) == {sizes[s]}
    assert (got.taken <= 3 * got["size"]).all()
    whole = mixed_documents(Workspace(spark, "t"), df)
    taken = collections.Counter()
    for r in whole.collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert all(taken[r.doc_id] == r.taken for r in got.itertuples()) and whole.columns == df.columns
    words = rng.integers(0, 500, 64)
    quota = split_quota(words, int(words.sum() // 3), np.random.default_rng(1))
    assert quota.sum() == words.sum() // 3 and (quota <= words).all() and (quota >= 0).all()
    assert (split_quota(np.array([10**12, 10**12]), 10**11, np.random.default_rng(1)).sum()) == 10**11
    odd = mix(Workspace(spark, "t"), docs)
    assert odd.where("taken > 3 * size").count() == 0 and odd.where("doc_id = 2").first().taken == 0
    assert mix(Workspace(spark, "t"), none).count() == 0 and mixed_documents(Workspace(spark, "t"), none).count() == 0
    assert set(mixed_documents(Workspace(spark, "t"), docs).columns) == set(docs.columns)


def test_pipeline_stages_on_awkward_tables(spark, docs, none, tables):
    """Nulls, empty and very long texts, repeated rows, clashing columns and no rows, through every stage."""
    import corpus_pipeline as cp
    from karst.llm.mixing import mix

    before = docs.count()
    for name, stage in cp.STAGES:
        assert stage(spark, none, tables).count() == 0
        out = stage(spark, docs, tables)
        rows = out.collect()
        if name == "packing":
            assert sum(r.start == 0 for r in rows) == before
            continue
        assert out.columns == docs.columns
        if name == "toxicity":
            assert len(rows) == before  # no labelled document is among them
        if name == "near_dedup":
            ids = collections.Counter(r.doc_id for r in rows)
            assert ids.pop(None) == 2 and set(ids.values()) == {1} and {1, 2, 3, 4, 10} <= set(ids) and 9 not in ids
        if name == "pii":
            assert len(rows) == before and not any("me@example.com" in (r.text or "") for r in rows)
        if name == "mixing":
            taken, emitted = collections.Counter(), collections.Counter()
            for r in mix(Workspace(spark, "t"), docs).collect():
                taken[r.doc_id, r.source] += r.taken
            for r in rows:
                emitted[r.doc_id, r.source] += len(WORD.findall(r.text or ""))
            assert emitted == taken
