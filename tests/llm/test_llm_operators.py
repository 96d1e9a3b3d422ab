"""Each training-data operator against a brute-force version, with nulls, empty and odd texts, ties, repeats, empty tables."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkleaf.llm import components, langid, linededup, minhash, packing, pii, quality, sentencepieces, substring, tokencount, topk
from sparkleaf.llm.common import WordHashes, tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["É", "日本", "x,", "(y)", "12"]
    base = [prose(rng, rng.randint(1, 120), words) for _ in range(40)]
    shared = prose(rng, 60, words)
    out = [*base, *base[:5], *(" ".join([*b.split(), "tail"]) for b in base[5:15])]
    out += [f"{a} {shared} {b}" for a, b in zip(base[:8], base[8:16])]
    out += [f"{a}\nThe same long line here\n{b}\nTHE SAME LONG LINE HERE  \nshort" for a, b in zip(base[:6], base[6:12])]
    out += [None, "", " ", "\n", "\n\n", "a", "a b", "A B", "a  b", " lead", "trail ", "tab\tx", "\x00nul \x00", "▁ mark▁", "<|endoftext|> x", "é" * 50, "x" * 3000, "1 2 3 " * 40]
    rng.shuffle(out)
    return out


EMPTY = []


# ---- token counts and sentence pieces


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, texts, name):
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(table(spark, texts), tokenizer=name, batch_bytes=2000).collect()}
    if name.endswith(".model"):
        whole = lambda t: len(sentencepieces.processor(tokenizer_file(name)).encode(t))
    else:
        whole = lambda t: len(tokencount.bpe(tokenizer_file(name)).encode(t, add_special_tokens=False).ids)
    assert got == {i: whole(t or "") for i, t in enumerate(texts)}


def test_token_counts_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7)], "doc_id long, text string, n_tokens int")
    assert [tuple(r) for r in tokencount.token_counts(df).collect()] == [(1, "a b", 2)] * 2
    assert tokencount.token_counts(table(spark, EMPTY)).count() == 0


def test_chunks_follow_the_library_on_odd_white_space():
    rng = random.Random(2)
    parts = ["a", "b c", " ", "  ", "\n", "\n\n", "\t", "\xa0", "<|endoftext|>", "1", "'s", "▁", "\0", "é", "　", "\x1c", ".", "\r\n", "\x85", "\x1e", "_", "x,", "!?"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    import pyarrow as pa

    path = tokenizer_file("byte_bpe_50k.json")
    ids, ends = tokencount.bpe_table(path).ids(pa.array(odd))
    library = tokencount.bpe(path)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode(t, add_special_tokens=False).ids for t in odd]
    path = tokenizer_file("piece_bpe_32k.model")
    ids, ends = sentencepieces.table_of(path).ids(pa.array(odd))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == sentencepieces.processor(path).encode(odd)


def test_sentencepiece_round_trip(spark, texts):
    sp = sentencepieces.processor(tokenizer_file("piece_bpe_32k.model"))
    rows = sentencepieces.decode(sentencepieces.encode(table(spark, texts))).select("doc_id", "ids", "decoded").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert r["ids"] == ids
        assert r["decoded"] == sp.decode(ids)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 264, 2])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in sentencepieces.decode(odd).orderBy("doc_id").collect()] == ["", "", sp.decode([264, 2])]


def test_sentencepiece_sends_what_it_reads_once(spark):
    """Texts and ids went to the workers twice, in the row and as the value, which took an executor over its memory."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    coded = sentencepieces.encode(docs)
    for df, read in ((coded, "text"), (sentencepieces.decode(coded), "ids")):
        plan = df._jdf.queryExecution().analyzed().toString()
        sent = re.search(r"struct\((.*?)\) AS row", plan)[1]
        assert f"c{(df.columns.index(read))}" not in re.findall(r"\w+", sent)
        assert df.columns[: df.columns.index(read) + 1] == [*docs.columns, "ids"][: df.columns.index(read) + 1]
    assert [(r["text"], r["decoded"]) for r in sentencepieces.decode(coded).orderBy("doc_id").collect()] == [("a b", "a b"), (None, "")]
    numbers = sentencepieces.encode(spark.createDataFrame([(7,)], "text long"))
    assert numbers.dtypes[0] == ("text", "bigint") and numbers.first()["text"] == 7
    assert sentencepieces.encode(docs, out_col="text").orderBy("doc_id").collect()[1]["text"] == [2]


# ---- packing


def test_packing_is_gapless_and_whole(spark, texts):
    docs = table(spark, [*texts, "word " * 5000])
    pieces = packing.tokenize_pieces(docs, 256)
    rows = packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc"), F.lit(1).alias("offset")), 256, groups=2).collect()
    library = tokencount.bpe(tokenizer_file("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate([*texts, "word " * 5000]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]]
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 256 for r in own[1:])
        assert [r["crc"] for r in own] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]
    for rs in by_sequence.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == [0, *np.cumsum([r["length"] for r in rs])[:-1]]
        assert sum(r["length"] for r in rs) <= 256
    assert packing.pack(packing.tokenize_pieces(table(spark, EMPTY)).drop("ids")).count() == 0


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_best_fit_holds_every_capacity(by):
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 180, 400))[::-1]
    bins, offsets = packing.best_fit(lengths, 256, 5, 256 * 128, (1.0, 0.1, 0.1), by)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 256 and len(own) <= 5 and (own**2).sum() <= 256 * 128
    free, _ = packing.best_fit(lengths, 256, 256, 256**2, (1.0, 0.01, 0.01))
    assert free.max() + 1 <= np.ceil(lengths.sum() / 256) * 1.03 + 1


# ---- top-k


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in np.round(v, 2)]) for i, v in enumerate(rng.normal(size=(230, 6)) * (rng.random((230, 6)) < 0.5))]
    vectors += [(300, vectors[7][1]), (301, None), (302, [1.0, None]), (303, [float("nan")]), (304, [float("inf")]), (None, [1.0]), (400, [])]
    rows = topk.sparse_rows(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = {}
    for r in topk.search(rows.where("id % 100 = 0"), rows, 10, block_rows=50, query_rows=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"], r["score"]))
    live = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    assert set(got) == {i for i in live if i % 100 == 0}
    for q, found in got.items():
        scores = sorted((-sum(a * b for a, b in zip(live[q], v)), i) for i, v in live.items() if i != q)[:10]
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    few = rows.where("id < 4")
    assert topk.search(few.where("id = 0"), few, 10).count() == 3
    assert topk.search(few.where("id = 0"), few.where("id > 99"), 10).count() == 0


# ---- language


def test_language_id_learns_and_holds_out(spark):
    rng = random.Random(8)
    kinds = {"xx": "abcde", "yy": "fghij", "zz": "klmno"}
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(20)), lang, "s", 0) for i, (lang, letters) in enumerate(itertools.islice(itertools.cycle(kinds.items()), 240))]
    rows += [(900, None, "xx", "s", 0), (901, "12 34 ...", "yy", "s", 0), (902, "abcde abc", None, "s", 0), (903, "", "zz", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs.where(langid.fold() != 1), rows_per_label=40)
    assert model.labels == ["xx", "yy", "zz"] and model.temperature > 0
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i][c] == v for i in (900, 901, 903) for c, v in (("lang_pred", "und"), ("score", 0.0)))
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[902]["lang_pred"] == "xx"
    none = langid.fit(docs.where("lang = 'nothing'"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def test_ngrams_do_not_cross_texts():
    rng = random.Random(4)
    some = ["".join(rng.choice("ab é1. ") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    buckets, ends, has = langid.ngrams(some)
    for i, t in enumerate(some):
        alone, e, h = langid.ngrams([t])
        assert np.array_equal(buckets[ends[i] : ends[i + 1]], alone[: e[1]])
        assert has[i] == h[0] == any(c.isalpha() for c in t)


# ---- quality


def brute_quality(text, n=5):
    words = WORD.findall(text)
    grams = {}
    for i in range(len(words) - n + 1):
        grams.setdefault(tuple(words[i : i + n]), []).append(i)
    covered = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(n)}
    seen, dup, chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup, chars = dup + 1, chars + len("".join(WORD.findall(line)))
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, chars, len(covered), sum(len(words[i]) for i in covered)


def test_quality_measures(spark, texts):
    more = [*texts, "a b c d e f " * 4, "x\nx\n\n\ny x\nx", "|#| % &" * 9]
    for r in quality.repetition(table(spark, more)).collect():
        n_words, chars, symbols, dup, dup_chars, repeat, covered = brute_quality(more[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["dup_line_chars"], r["n_repeat_words"], r["dup_ngram_chars"][sorted(quality.MAX_NGRAM_SHARE).index(5)]) == (n_words, chars, symbols, dup, dup_chars, repeat, covered)
        assert r["base_failed"] == (n_words < 10 or 100 * repeat > 20 * n_words)
        assert not (r["kept"] and r["base_failed"])
    for n, share in quality.MAX_NGRAM_SHARE.items():
        wh, t = WordHashes(), (more[-3] or "")
        assert quality.measures(t.encode(), wh, (n,))[6][0] == brute_quality(t, n)[6], share
    assert quality.repetition(table(spark, EMPTY)).count() == 0


# ---- line dedup


def brute_lines(docs, min_chars=10):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    owner = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            owner[key(x)] = min(i, owner.get(key(x), i))
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or owner[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark, texts):
    more = [*texts, "ÄÖÜÄÖÜÄÖÜÄ\nB", "äöüäöüäöüä\nÄÖÜÄÖÜÄÖÜÄ", "A line of its own \r\nA line of its own"]
    got = linededup.dedup_lines(table(spark, more).repartition(5)).collect()
    expect = brute_lines(list(enumerate(more)))
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in got} == expect
    assert linededup.dedup_lines(table(spark, EMPTY)).count() == 0
    odd = spark.createDataFrame([(None, "a line of ten"), (1, "a line of ten"), (1, "a line of ten"), (2, "a line of ten")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in linededup.dedup_lines(odd).collect()) == [(0, "a line of ten"), (1, "a line of ten"), (1, "a line of ten"), (2, "")]


def test_levelled_runs_keep_the_smallest_owner():
    rng = np.random.default_rng(4)
    runs, owner, lost = linededup.LevelledRuns(3), {}, set()
    for _ in range(40):
        keys = np.array([b"%016d" % x for x in rng.integers(0, 60, 25)], "S16")
        docs = rng.integers(0, 500, 25)
        lost |= set(zip(*map(list, (a.tolist() for a in runs.add(keys, docs)))))
        for k, d in zip(keys.tolist(), docs.tolist()):
            owner.setdefault(k, set()).add(d)
    keys, owners = runs.drain()
    assert dict(zip(keys.tolist(), owners.tolist())) == {k: min(d) for k, d in owner.items()}
    assert lost == {(k, d) for k, ds in owner.items() for d in ds if d > min(ds)}
    assert len(runs) == 0


# ---- near duplicates


def brute_components(docs, n, percent):
    def grams(t):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = {i: grams(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, texts, words):
    rng = random.Random(1)
    long = prose(rng, 80, [f"w{i}" for i in range(400)]).split()
    chain = []
    for i in range(30):  # neighbours are alike, ends aren't
        chain.append(" ".join(long))
        for _ in range(1 + i % 4):
            long[rng.randrange(80)] = f"new{rng.random()}"
    more = [*texts, *chain]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(table(spark, more), words, 80).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(list(enumerate(more)), words, 80)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_odd_rows(spark):
    assert minhash.near_duplicates(table(spark, EMPTY)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (7, None), (7, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(odd).collect()) == [(0, 0, True), (3, 3, True), (5, 3, False), (7, 7, True), (7, 7, True)]


def test_open_buckets_are_compared_in_tiles(spark):
    """Members of one bucket that the least one doesn't link are still compared with each other."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    cut = lambda n: " ".join(x for i, x in enumerate(base) if not n <= i < n + 25)
    docs = [cut(0), cut(90), cut(91), cut(92), cut(170), cut(171)]
    rng.shuffle(docs)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, docs), 2, 80).collect()}
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(docs)), 2, 80).items()}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- substring dedup


def brute_substrings(docs, n=13):
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i, w in words.items():
        for j in range(len(w) - n + 1):
            g = tuple(w[j : j + n])
            first[g] = min(i, first.get(g, i))
    out = {}
    for i, w in words.items():
        gone = {j + k for j in range(len(w) - n + 1) if first[tuple(w[j : j + n])] < i for k in range(n)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("n", [13, 7, 20])
def test_substring_dedup(spark, texts, n):
    got = substring.dedup_substrings(table(spark, texts), n).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in got} == brute_substrings(list(enumerate(texts)), n)
    assert substring.dedup_substrings(table(spark, EMPTY), n).count() == 0


def test_substring_dedup_numbers_many_short_documents_of_a_task(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:  # 70000 documents in one partition, each later half a window of the earlier one with a word before it
        docs = spark.range(0, 70000, 1, 1).selectExpr("id AS doc_id", "concat(IF(id < 35000, '', concat('own', id, ' ')), array_join(transform(sequence(0, 12), i -> concat('w', id % 35000, 'x', i)), ' ')) AS text")
        got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring.dedup_substrings(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 70000
    assert [i for i in range(35000) if got[i][1]] == []
    assert [i for i in range(35000, 70000) if got[i] != (f"own{i}", 13)] == []


def test_difference_cover_meets_every_pair_of_offsets():
    for a, b in itertools.product(range(substring.PERIOD), repeat=2):
        assert any((a + s) % substring.PERIOD in substring.COVER and (b + s) % substring.PERIOD in substring.COVER for s in range(substring.PERIOD))


# ---- personal data


def base_by_rule(text):
    out = []
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    for spans in (email, ip, card, phone):
        out.append(spans)
    return out


def test_base_spans_follow_the_rules():
    rng = random.Random(9)
    parts = ["a@b.c", "a@b", "x.y@z-1.co.uk", "@", ".", "1.2.3.4", "256.1.1.1", "001.2.3.4", "1.2.3.4.5.6.7.8", "4583540886970625", "4583 5408 8697 0625", "+1 (852) 555-5043", "+", "12", "-", " ", "_c@d.e", "é", "a", "\n", "(", "+12345678", "++49 1234567890"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(t) == base_by_rule(t), t
    assert pii.base_spans("1" * 60_000 + "." + "a" * 60_000 + "@")[1:] == [[], [], []]


@pytest.fixture(scope="module")
def tagger():
    return pii.train()


def test_tagger_finds_held_out_mentions(tagger):
    rng = random.Random(1234)
    made = [pii.labelled(rng) for _ in range(300)]
    none = [[[] for _ in pii.KINDS] for _ in made]
    got = pii.added_spans(tagger, [t for t, _ in made], none)
    hit = false = total = 0
    for (_, spans), found in zip(made, got):
        gold, own = set(spans), {(k, *s) for k in range(len(pii.KINDS)) for s in found[k]}
        hit, false, total = hit + len(gold & own), false + len(own - gold), total + len(gold)
    assert hit >= 0.85 * total and false <= 0.02 * total


def test_find_and_mask(spark, tagger):
    rows = ["Write to jo.doe@mail.example.com or call +1 (852) 555-5043 4583540886970625 soon", "Nothing here, version 3.0 of 2024 and 12 %", None, "", "x" * 5000 + " 10.0.0.1 " + "y" * 5000]
    got = {r["doc_id"]: r for r in pii.mask(table(spark, rows), tagger=tagger).collect()}
    assert got[0]["text"] == "Write to <email> or call <phone> <card> soon"  # the rules alone find neither number
    assert [got[i]["text"] for i in (1, 2, 3)] == [rows[1], None, ""]
    assert got[4]["text"] == "x" * 5000 + " <ip> " + "y" * 5000
    spans = {r["doc_id"]: r["pii"] for r in pii.find(table(spark, rows), tagger=tagger).collect()}
    for i, t in enumerate(rows):
        base = base_by_rule(t or "")
        assert [(s["kind"], s["start"], s["end"]) for s in spans[i] if s["base"]] == [(pii.KINDS[k], *s) for k in range(4) for s in base[k]]
    assert pii.find(table(spark, EMPTY), tagger=tagger).count() == 0


def test_left_out_windows_change_nothing(tagger):
    """Mentions of up to 120 characters, anywhere in a text, are found as if every window were decoded."""
    rng = random.Random(2)
    part = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = ["", "a", "1", "@", "x" * 128, "7 " * 300, "+" + "1 " * 200 + "@" * 90]
    for size in range(8, 121, 4):
        local = ".".join(part(7) for _ in range(max(1, size // 16)))[: max(1, size - 12)]
        domain = ".".join(part(6) for _ in range(max(1, size // 14))) + ".com"
        mention = local + rng.choice(["@", " @ ", "@ ", " @"]) + domain
        number = rng.choice([" ", "  ", "-", "."]).join(part(0) + "".join(rng.choice("0123456789") for _ in range(4)) for _ in range(max(2, size // 5)))
        texts.append(" ".join([prose(rng, rng.randint(0, 60), ["some", "words", "2024", "and", "x.y", "v1.2"]), mention, prose(rng, rng.randint(0, 40), ["more", "here", "7,5"]), number, "end"]))
    texts += [pii.labelled(rng)[0] for _ in range(150)]
    none = [[[] for _ in pii.KINDS] for _ in texts]
    everywhere = pii.added_spans(tagger, texts, none, everywhere=True)
    assert pii.added_spans(tagger, texts, none) == everywhere
    long = [e - s for found in everywhere for s, e in found[0]]
    assert max(long) > 64  # longer than the windows' own parts


def test_grid_covers_every_character_once():
    for n in range(1, 700):
        starts, ends = pii.grid(n)
        begins = [0, *ends[:-1].tolist()]
        assert ends[-1] == n and all(a < b for a, b in zip(begins, ends))
        for j in range(n):
            depth = [min(j - s if s else 10**6, s + pii.WINDOW - 1 - j if s + pii.WINDOW < n else 10**6) for s in starts.tolist()]
            own = next(k for k, e in enumerate(ends) if j < e)
            assert depth[own] == max(depth), (n, j)


def small_tagger(rng):
    shape = lambda *s: 0.5 * rng.standard_normal(s)
    h, e = pii.HIDDEN, pii.EMBED
    return pii.Tagger(shape(pii.N_CLASSES, e), shape(2, e, 4 * h), shape(2, h, 4 * h), shape(2, 4 * h), shape(2 * h, pii.TAGS), shape(pii.TAGS), shape(pii.TAGS, pii.TAGS))


def test_crf_against_all_paths():
    rng = np.random.default_rng(4)
    m = small_tagger(rng)
    x = rng.integers(1, pii.N_CLASSES, (3, 4))
    em, _ = pii._emissions(m, x)
    trans = m.trans + pii._allowed()
    y = np.array([[0, 1, 2, 2], [3, 4, 0, 0], [0, 0, 5, 6]])
    score = lambda i, p: sum(em[i, t, p[t]] for t in range(4)) + sum(trans[p[t], p[t + 1]] for t in range(3))
    paths = list(itertools.product(range(pii.TAGS), repeat=4))
    total = 0.0
    for i in range(3):
        scores = np.array([score(i, p) for p in paths])
        assert tuple(pii.viterbi(m, x)[i]) == paths[int(scores.argmax())]
        total += np.log(np.exp(scores - scores.max()).sum()) + scores.max() - score(i, y[i])
    assert abs(pii._step(m, x, y)[0] - total / 3) < 1e-6


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(5)
    m = small_tagger(rng)
    x, y = rng.integers(1, pii.N_CLASSES, (2, 5)), np.array([[0, 1, 2, 0, 0], [3, 4, 4, 0, 7]])
    _, grads = pii._step(m, x, y)
    for p, g in zip(m.params(), grads):
        for at in (tuple(rng.integers(0, s) for s in p.shape) for _ in range(6)):
            if p is m.embed:
                at = (x[0, 0], at[1])
            old = p[at]
            p[at] = old + 1e-5
            up = pii._step(m, x, y)[0]
            p[at] = old - 1e-5
            down = pii._step(m, x, y)[0]
            p[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


# ---- odd tables


def test_substring_dedup_of_a_repeated_doc_id(spark):
    """Each row of a doc_id is judged by its own words; a copy of a smaller document goes, a text of its own stays."""
    t, u, v = (" ".join(f"{c}{i}" for i in range(40)) for c in "tuv")
    rows = [(5, t), (7, t), (7, u), (7, u), (9, u + " " + v), (None, t), (11, None), (11, t)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["text"]) for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(5, 40, 0, t), (7, 40, 40, ""), (7, 40, 0, u), (7, 40, 0, u), (9, 80, 40, v), (0, 40, 0, t), (11, 0, 0, ""), (11, 40, 40, "")])


def test_near_duplicates_of_a_repeated_doc_id(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(40)) for c in "tu")
    rows = [(1, t), (4, t), (4, u), (6, u), (6, u), (8, None), (8, t)]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 36): 1, (4, 36): 1, (6, 36): 1, (8, 0): 1, (8, 36): 1} or got[8, 0] == 8


def test_large_groups_are_confirmed_in_several_tiles(spark, monkeypatch):
    for name, value in (("TILE_ROWS", 6), ("SIFT_ROWS", 5), ("CENTRES", 2)):
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for _ in range(40):
        words = list(base)
        for _ in range(rng.randint(2, 9)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**9)}"
        docs.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, docs), 2, 80).collect()}
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(docs)), 2, 80).items()}


def test_letters_beyond_the_second_plane(spark):
    model = langid.Model(["a", "b"], np.zeros((langid.BUCKETS, 2), np.float32), np.array([1.0, 0.0]), 1.0)
    rows = langid.predict(spark.createDataFrame([(1, "\U00030000\U00030001"), (2, "12 ."), (3, None), (3, None)], "doc_id long, text string"), model).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in rows) == [(1, "a"), (2, "und"), (3, "und"), (3, "und")]
    assert langid.predict(table(spark, EMPTY), model).count() == 0


WORDS_40 = " ".join(f"q{i}" for i in range(40))
#: Null ids and texts, repeated rows, and a long text, under columns whose names operators might use themselves.
CLASHING = [(1, WORDS_40, 0), (1, WORDS_40, 1), (None, WORDS_40, 2), (3, None, 3), (4, "", 4), (5, "long " * 30_000, 5), (5, "long " * 30_000, 6)]
NAMES = ["row", "keys", "found", "__doc", "__group", "part", "N_LINES", "N_Words", "Kept", "Lang_Pred", "a b`c.d", "text_hash", "whole", "value", "made"]


@pytest.mark.parametrize("name", ["packing", "langid", "encode", "decode", "near", "quality", "lines", "counts", "substrings", "find", "mask"])
def test_clashing_names_nulls_and_repeats(spark, tagger, name):
    plain = spark.createDataFrame(CLASHING, "doc_id long, text string, id int")
    df = plain.select("doc_id", "text", "id", *[F.col("id").alias(n) for n in NAMES])
    model = langid.Model(["a"], np.zeros((langid.BUCKETS, 1), np.float32), np.zeros(1), 1.0)
    made = {
        "packing": lambda d: packing.pack(d.withColumns({"piece": F.lit(0), "length": F.when(F.col("id") != 3, F.col("id"))}), 16, groups=2),
        "langid": lambda d: langid.predict(d, model),
        "encode": sentencepieces.encode,
        "decode": lambda d: sentencepieces.decode(d.withColumn("ids", F.array(F.lit(264), F.lit(2)))),
        "near": minhash.near_duplicates,
        "quality": quality.repetition,
        "lines": linededup.dedup_lines,
        "counts": tokencount.token_counts,
        "substrings": substring.dedup_substrings,
        "find": lambda d: pii.find(d, tagger=tagger),
        "mask": lambda d: pii.mask(d, tagger=tagger),
    }[name]
    out, expect = made(df), made(plain)
    shared = [c for c in expect.columns if c in out.columns]
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert {"doc_id"} <= set(shared) and set(expect.columns) == set(shared)
    rows = lambda d: sorted(map(repr, (tuple(r) for r in d.select(*shared).collect())))
    if name == "packing":  # which of equal pieces comes first isn't stated
        shared = [c for c in shared if c not in ("sequence_id", "offset")]
    assert rows(out) == rows(expect)
    if name != "near":
        assert {r["a b`c.d"] for r in out.select(F.col("`a b``c.d`")).collect()} == set(range(7))
        assert out.count() == len(CLASHING)
    assert made(df.limit(0)).count() == 0
