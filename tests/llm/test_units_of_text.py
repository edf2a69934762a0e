"""Periodic runs, fill-in-middle and pieces against plain versions of their definitions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from massloom.llm import infill, pieces, runs

CLASHING = ["n", "form", "output", "ids", "runs", "words", "h", "a", "p", "g", "tail", "collapsed", "best", "__nth"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sample_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 5)))
    prose = lambda n: [word() for _ in range(n)]
    texts = [None, "", " \n\t\r", "one", "x" * 3000, "ab " * 400, "a b c　d", "<P> in a text", "ends with <M>", "almost <S", "😀 smile▁ twice  " * 9, "\x00null\x0bbyte\x1c", "Zeile.\n\nÜber! " * 30]
    for _ in range(40):
        w = prose(rng.randint(0, 60))
        w += prose(rng.randint(1, 20)) * rng.randint(1, 6) + prose(rng.randint(0, 9))
        if rng.random() < 0.4:
            w = w * 3 + w[: rng.randrange(len(w))]
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    texts += [" ".join(prose(2000)), " ".join(prose(150) * 12), texts[-1], texts[20], texts[20]]
    rows = [(i * 11 - 20, t) for i, t in enumerate(texts)]
    return [*rows, (None, "no id but words"), (None, None), (None, "ab " * 50), rows[20], (rows[21][0], "another text of that id")]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(*r, i) for i, r in enumerate(sample_rows())]
    df = spark.createDataFrame(rows, "doc_id long, text string, serial int")
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHING)).repartition(5)


def plain_words(text):
    return [w for w in re.split("[\x20\t-\r]+", text or "") if w]


def plain_runs(words, least, times):
    found = {}
    for q in range(1, len(words) // times + 1):
        at = 0
        while at + q < len(words):
            stop = at
            while stop + q < len(words) and words[stop] == words[stop + q]:
                stop += 1
            if stop - at + q >= max(least, times * q):
                found.setdefault((at, stop + q), q)
            at = max(stop, at + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_symbols():
    rng = random.Random(4)
    seen = 0
    for _ in range(1500):
        least, times = rng.choice([(24, 3), (6, 3), (4, 2), (2, 2), (1, 2), (9, 4)])
        kinds, symbols = rng.randint(1, 4), []
        for _ in range(rng.randint(0, 12)):
            if symbols and rng.random() < 0.4:
                a = rng.randrange(len(symbols))
                symbols += symbols[a : rng.randint(a + 1, len(symbols))] * rng.randint(1, 4)
            else:
                symbols += [rng.randrange(kinds) if rng.random() < 0.7 else rng.randrange(9) for _ in range(rng.randint(1, 8))]
            symbols = symbols[:200]
        expected = plain_runs(symbols, least, times)
        seen += len(expected)
        assert runs.runs_of(symbols, least, times) == expected
        assert runs.word_runs([str(s).encode() for s in symbols], least, times) == expected
    assert seen > 5000


def test_factors_occur_before():
    rng = random.Random(9)
    for _ in range(200):
        symbols = [rng.randrange(3) for _ in range(rng.randint(1, 60))]
        at = 0
        for start, end, distance in runs.lz_factors(symbols):
            assert start == at and (distance > 0 and symbols[start:end] == symbols[start - distance : end - distance] or end == start + 1 and symbols[start] not in symbols[:start])
            later = symbols[start : end + 1]
            assert end == len(symbols) or not distance or all(symbols[k : k + len(later)] != later for k in range(start))
            at = end
        assert at == len(symbols)


def test_find_runs(documents):
    rows = sample_rows()
    found = runs.find_runs(documents, 24, 3).collect()
    expected = []
    for i, text in rows:
        words = plain_words(text)
        own = plain_runs(words, 24, 3) if len(set(words)) < len(words) else []
        expected.append((i, own, plain_collapsed(words, own)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found), key=key) == sorted(expected, key=key)
    assert sum(len(r[1]) for r in expected) > 20


def test_planted_runs_and_digests(documents):
    rows = [r for r in sample_rows() if r[0] is not None and len(plain_words(r[1])) < 5000]
    ids = [r[0] for r in rows]
    expected = []
    for i, text in rows:
        words, h = plain_words(text), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        own = plain_runs(words, 24, 3)
        best = min(own, key=lambda r: (-r[1] / r[2], r[0], r[2])) if own else (None, None, None)
        expected.append((i, len(own), *best, 1000 * best[1] // best[2] if own else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in own)), sha(plain_collapsed(words, own))))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids) >= 3
    made = runs.run_digests(runs.find_runs(runs.plant_runs(documents.filter(F.col("doc_id").isin(ids)))))
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, expected))
    assert runs.run_digests(runs.find_runs(runs.plant_runs(documents.filter("doc_id IS NULL")))).count() == 3
    for other in ({"times": 1}, {"least": 0}):
        with pytest.raises(ValueError):
            runs.find_runs(documents, **other)


def plain_infill(i, text, seed=1, fim=90, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= fim:
        return i, n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < spm:
        return i, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("share", [(90, 20), (100, 100), (100, 0), (0, 50)])
def test_fill_in_middle(documents, share):
    made = infill.fill_in_middle(documents, *share)
    expected = [plain_infill(*r, 1, *share) for r in sample_rows()]
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, expected))
    digests = infill.infill_digests(made).collect()
    texts = [r[1] or "" for r in sample_rows()]
    assert sorted(map(repr, map(tuple, digests))) == sorted(repr((*e[:5], sha(e[5]), sha(t))) for e, t in zip(expected, texts, strict=True))


def test_cuts_at_every_rank():
    text = "ab c😀dEf  9\nZ"
    units = infill.UNIT.findall(text)
    assert infill.count_units(text) == len(units) and infill.count_units("") == 0
    for low in range(len(units) + 1):
        for high in range(low, len(units) + 1):
            assert infill.cut_places(text, low, high) == (len("".join(units[:low])), len("".join(units[:high])))


def test_sentinels_beside_odd_ends(spark):
    texts = ["<<<", ">P>", "<P<S<M", "P>S>M>", "<", "a<b", "S><", "\n<\n"]
    df = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(160)], "doc_id long, text string")
    for r in infill.fill_in_middle(df, 100, 50).select("form", infill.restored("output", "form").alias("back"), "doc_id").collect():
        assert r["back"] == texts[r["doc_id"] % len(texts)] and r["form"] != "plain"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_of_odd_texts(library):
    own = pieces.vocabulary()
    rng = random.Random(6)
    parts = ["a", "e", "the", "ing", " ", "  ", "\n", "\t", "é", "日", "本", "😀", "▁", "=", "==", "----", "*", "\x00", "<0x0A>", "</s>", "<s>", "<unk>", "1", "2024", "ß", "́", "क", "ि", " " * 17, "tion", "　"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        ids = np.frombuffer(own.encode(text), np.int32)
        assert ids.tolist() == library.encode(text) and own.decode(ids) == library.decode(ids.tolist())
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(260), 29_871, rng.choice([0, 1, 2, 13, 259])]) for _ in range(rng.randint(0, 8))]
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids)
    run = "abcdefghij" * 5000  # one word
    assert np.frombuffer(own.encode(run), np.int32).tolist() == library.encode(run)


def test_last_tokens_are_those_of_each_prefix(library):
    own = pieces.vocabulary()
    for word in ("▁representation", "▁unbelievably", "▁▁▁▁Straßenbahn", "lllllllllll"):
        for k, (token, length) in enumerate(own.last_tokens(word), 1):
            assert own.merged(word[:k])[-1] == own.piece[token] == word[k - length : k]


def test_piece_round_trip(documents, library):
    expected = []
    for i, text in sample_rows():
        ids = library.encode(text or "")
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    encoded = pieces.encode_documents(documents)
    made = pieces.piece_digests(pieces.decode_documents(encoded)).collect()
    assert sorted(map(repr, map(tuple, made))) == sorted(map(repr, expected))
    null = encoded.limit(1).select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert [(r["ids"], r["text"]) for r in pieces.decode_documents(null).collect()] == [(None, "")]


def test_empty_tables(documents):
    none = documents.limit(0)
    assert runs.find_runs(none).collect() == [] and runs.plant_runs(none).collect() == []
    assert infill.fill_in_middle(none).collect() == [] and pieces.decode_documents(pieces.encode_documents(none)).collect() == []
