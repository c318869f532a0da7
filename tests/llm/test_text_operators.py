"""Quality rules, fingerprints, packing, pieces, passages: small tables against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from stellwerk.llm import packing, piece_codec
from stellwerk.llm.fingerprints import fingerprints
from stellwerk.llm.packing import pack, sum_of_squares
from stellwerk.llm.quality_rules import clean_documents, judge
from stellwerk.llm.registry import packed, vocabulary, word_pattern
from stellwerk.llm.substring_dedup import remove_repeated_passages

WORDS = re.compile("[^\x20\x09-\x0d]+")
GOOD = " ".join(f"word{i}" for i in range(60)) + "."
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t\x0b "),
    (4, "One two"),
    (5, GOOD),
    (5, GOOD),
    (6, GOOD + "\nHome | News | Sport | More\n" + GOOD.upper()),
    (7, "a b c a b c x a b c\n\na b c\n" + "é ü 日本語 " * 30),
    (8, "x" * 200_000 + " " + "the end. " * 2000),
    (None, "no id at all but a text, and <|endoftext|> in it"),
    (9, "tab\tand\xa0nbsp　wide  spaces \r\n trailing \n"),
    (10, "CLICK!! HERE!! " * 30 + "\n" + "### *** $$$ %%% " * 20),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string").selectExpr("*", "'q' AS quality", "1 AS row", "2 AS key", "3 AS hits", "4 AS n_removed")


def counts(text):
    ws = WORDS.findall(text or "")
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    repeated = {w for w in windows if windows.count(w) > 1} if len(windows) < 5000 else None
    covered = None if repeated is None else len({i + k for i, w in enumerate(windows) if w in repeated for k in range(3)})
    lines = [line for line in (text or "").split("\n") if WORDS.search(line)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), covered


def test_quality_counts(odd):
    rows = judge(odd).selectExpr("row.doc_id AS i", "row.text AS t", "quality.*").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        n_words, chars, symbols, dup, covered = counts(r.t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n_words, chars, symbols, dup)
        if covered is not None:
            assert r.n_repeat_words == covered, r.i
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = {r.i: r.kept for r in rows}
    assert kept[5] and kept[6] is False and not kept[10] and not kept[1]


def test_clean_documents(spark):
    text = GOOD + "\nHome | News | Sport\n" + GOOD.replace("word", "term")
    docs = spark.createDataFrame([(1, text, 5, "x"), (2, "short", 5, "x")], "doc_id bigint, text string, n_chars bigint, quality string")
    (row,) = clean_documents(docs).collect()
    assert row.text == text.replace("Home | News | Sport\n", "") and row.n_chars == len(row.text) and row.quality == "x"
    assert clean_documents(docs.limit(0)).count() == 0


def test_clean_documents_keep_blank_lines(spark):
    texts = [GOOD + "\n\n" + GOOD.replace("word", "term") + "\n \t\n\nEnd.\n", "\n\n" + GOOD + "\n\nHome | News | Sport\n\nEnd."]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")
    found = {r.doc_id: r for r in clean_documents(docs).collect()}
    assert found[0].text == texts[0] and found[1].text == texts[1].replace("Home | News | Sport\n", "")
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_fingerprints(spark, odd):
    rows = fingerprints(odd).collect()
    assert len(rows) == len(ODD)
    order = sorted({(i is not None, i or 0) for i, _ in ODD})
    texts = {(i is not None, i or 0): t or "" for i, t in ODD}
    for r in rows:
        key = (r.doc_id is not None, r.doc_id or 0)
        text, following = texts[key], texts[order[(order.index(key) + 1) % len(order)]]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].fingerprint == "" and by_id[2].near_next == 1.0 and by_id[5].near_edited > 0.5
    alone = fingerprints(odd.where("doc_id = 4")).first()
    assert alone.near_next == 1.0
    assert fingerprints(odd.limit(0)).count() == 0


def test_fingerprint_follows_shared_text(spark):
    shared, other = " ".join(f"s{i}" for i in range(300)), " ".join(f"o{i}" for i in range(300))
    docs = spark.createDataFrame([(1, shared), (2, "x y z " + shared), (3, other)], "doc_id bigint, text string")
    by_id = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert by_id[1].near_next > 0.9 and by_id[2].near_next == 0 and 0.55 < by_id[1].near_edited < 0.95


def test_packing(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    extra = [(100 + i, " ".join(f"w{i * j % 97}" for j in range(5 + 13 * i))) for i in range(60)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    for group in (packing.GROUP, 16):
        monkeypatch.setattr(packing, "GROUP", group)
        rows = pack(docs, vocabulary("byte_bpe_50k.tiktoken"), word_pattern()).collect()
        wanted = {}
        for i, text in ODD + extra:
            ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
            cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
            for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                wanted.setdefault((i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())), []).append(1)
        assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))) == sorted(str(k) for k, n in wanted.items() for _ in n)
        sequences = {}
        for r in rows:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(sequences) <= -(-sum(r.length for r in rows) // 1024) + 3
    assert pack(docs.limit(0), vocabulary("byte_bpe_50k.tiktoken"), word_pattern()).count() == 0


def test_packing_finds_added_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "one<|endoftext|><|endoftext|> \n two  ", "é　x <|endoftext|>\n", "<|endoftext| >", "plain  text"]
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for rows in (packed(docs).collect(), corpus_pipeline.packing(spark, docs, "").collect()):
        for r in rows:
            ids = np.array(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], "<u4")
            assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())), texts[r.doc_id]
        assert len(rows) == len(texts)


def test_sum_of_squares_takes_the_best_gap():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 40, 300))[::-1]
    bins = sum_of_squares(sizes, 50)
    level = {}
    for s, b in zip(sizes.tolist(), bins.tolist()):
        count = [0] * 51
        for used in level.values():
            count[50 - used] += 1
        fits = [g for g in range(s, 50) if count[g]]

        def squares(gap):
            after = list(count)
            after[gap] -= 1
            after[gap - s] += 1
            return sum(c * c for c in after[1:50])

        assert (b in level) == bool(fits)
        if fits:
            assert squares(50 - level[b]) == min(map(squares, fits))
        level[b] = level.get(b, 0) + s
    assert max(level.values()) <= 50


def test_piece_codec(spark, odd):
    import sentencepiece

    model = vocabulary("piece_bpe_32k.model")
    reference = sentencepiece.SentencePieceProcessor(model_file=model)
    extra = [(200, "    def f(x):\n        return  x"), (201, "aaaaaaaaaaa ﬁﬁ 😀\x00"), (202, " ")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    encoded = piece_codec.encode(docs, model)
    rows = piece_codec.decode(encoded, model).collect()
    assert sorted((str(r.doc_id), r.text, tuple(r.ids)) for r in rows) == sorted((str(i), t or "", tuple(reference.encode(t or ""))) for i, t in ODD + extra)
    assert piece_codec.digests(piece_codec.decode(piece_codec.encode(docs.limit(0), model), model)).count() == 0


def test_piece_codec_long_blanks_and_rounds(spark, odd, monkeypatch):
    """100,000 blanks merge in time that grows with their number; rounds of few characters give the same pieces."""
    import sentencepiece

    model = vocabulary("piece_bpe_32k.model")
    reference = sentencepiece.SentencePieceProcessor(model_file=model)
    tools = piece_codec.Vocabulary(model)
    blanks = "a" + " " * 100_000 + "b" + " " * 5
    assert tools.to_ids(tools.merged("▁a" + "▁" * 100_000 + "b" + "▁" * 5)[0]).tolist() == reference.encode(blanks)
    words = [w for _, t in ODD for w in re.findall("▁[^▁]*", "▁" + (t or "").replace(" ", "▁"))]
    whole = piece_codec.encode_words(tools, words)
    monkeypatch.setattr(piece_codec, "ROUND", 50)
    some = words[:60] + words[-60:]
    assert all((a == b).all() for a, b in zip([*whole[:60], *whole[-60:]], piece_codec.encode_words(tools, some)))
    assert len(piece_codec.encode_words(tools, [])) == 0
    rows = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(300, blanks)], "doc_id bigint, text string"))
    one = sorted(map(str, piece_codec.round_trip(rows, model).collect()))
    assert one == sorted(map(str, piece_codec.digests(piece_codec.decode(piece_codec.encode(rows, model), model)).collect()))
    none = spark.createDataFrame([(1, None), (2, []), (3, [5])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in piece_codec.decode(none, model).collect()}.keys() == {1, 2, 3}


def sentences(text):
    return [s for s in re.split(r"(?<=[.!?])[\x20\x09-\x0d]+|\n", text) if WORDS.search(s)]


def brute_passages(rows):
    """Runs of sentences by plain loops: removed sentences for each row."""

    def runs(ss):
        size = [len(WORDS.findall(s)) for s in ss]
        for i in range(len(ss)):
            e = next((e for e in range(i + 2, len(ss)) if sum(size[i : e + 1]) >= 12), None)
            if e is not None:
                yield i, e
            for k in (0, 1):
                if i + k < len(ss) and sum(size[i : i + k + 1]) >= 40:
                    yield i, i + k

    def words(ss):
        return tuple(w.lower() for s in ss for w in WORDS.findall(s))

    first, out = {}, {}
    for i, text in sorted(rows):
        ss = sentences(text)
        for a, e in sorted(runs(ss)):
            first.setdefault(words(ss[a : e + 1]), (i, a))
    for i, text in rows:
        ss = sentences(text)
        out[i] = len({k for a, e in runs(ss) if first[words(ss[a : e + 1])] != (i, a) for k in range(a, e + 1)})
    return out


def test_passages(spark, sf_dir):
    passage = "Here it begins. " + " ".join(f"P{i} stands here and says so." for i in range(12))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000 + i, f"Start of {i} is its own. {passage} The end of {i} is too.") for i in range(40)]
    rows += [(2000, "One. " * 50), (2001, " ".join(f"q{i}" for i in range(60)) + "."), (2002, "Own words.\n" + " ".join(f"Q{i}" for i in range(60)) + ".\nMore.")]
    docs = spark.createDataFrame([(i, t, len(t), "k") for i, t in rows], "doc_id bigint, text string, n_chars bigint, run string")
    found = {r.row.doc_id: r for r in remove_repeated_passages(docs).collect()}
    assert {i: r.n_removed for i, r in found.items()} == brute_passages(rows)
    assert found[1000].row.text == rows[200][1]
    assert found[1007].row.text == "Start of 7 is its own. The end of 7 is too." and found[1007].row.n_chars == len(found[1007].row.text)
    assert found[2002].row.text == "Own words.\nMore."


def test_passages_of_null_and_repeated_ids(spark):
    passage = " ".join(f"P{i} stands here and says so." for i in range(12))
    rows = [(None, f"Null row {i} begins. {passage} Null row {i} ends.") for i in range(30)]
    rows += [(i, f"Row {i} of {n} begins. {passage}") for i in (5, 6) for n in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = remove_repeated_passages(docs).collect()
    assert len(found) == len(rows)
    # One row of the smallest id keeps the passage; its own words stay with every row.
    assert sorted(r.n_removed for r in found) == [0] + [12] * 35
    assert [r.row.doc_id for r in found if r.n_removed == 0] == [5]
    assert {r.row.text for r in found if r.row.doc_id is None} == {f"Null row {i} begins. Null row {i} ends." for i in range(30)}


def test_passages_odd_rows(odd):
    rows = remove_repeated_passages(odd).collect()
    assert len(rows) == len(ODD) and all(r.row.hits == 3 for r in rows)
    assert [r.row.text for r in rows if r.row.doc_id == 1] == [None]
    assert [r.n_removed for r in rows if r.row.doc_id == 5] == [0, 0]
    assert remove_repeated_passages(odd.limit(0)).count() == 0
