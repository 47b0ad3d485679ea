"""op1: ids equal those of the tokenizers library, with any lexicon; round trips; edge cases."""

import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from turnlake.llm import bpe_lexicon as B

TEXTS = ["", None, "plain words, plain words", "I'll we've don't", " two  spaces \n\n and\ttabs ", "Ünïcödé ñandú ß 漢字 かな ١٢٣ ²³ ½", "x<|endoftext|>y<|endoftext|>", "a" * 3000, "😀😀 \x1c\x1d   ՘x", "aaaa    \n", "the the the"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(B.default_tokenizer())


@pytest.mark.parametrize("words", [0, 3, 1000])
def test_ids_equal_the_library(spark, tokenizer, words):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, TEXTS[2]])], "doc_id long, text string, ids string")
    path = B.default_tokenizer()
    lexicon = B.compile_lexicon(docs, path, words)
    rows = B.decode_documents(B.encode_documents(docs, path, lexicon), path).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = [*TEXTS, TEXTS[2]][r.doc_id] or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == ids
        assert r.text == tokenizer.decode(ids, skip_special_tokens=False) == text


def test_every_sure_character_splits_as_the_library_does():
    from tokenizers.pre_tokenizers import ByteLevel

    library = ByteLevel(add_prefix_space=False)
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000 or B.UNSURE.search(chr(cp)):
            continue
        for text in (f"a{chr(cp)}1", f" {chr(cp)}a", f"1{chr(cp)}{chr(cp)}!"):
            assert B.WORD.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)], hex(cp)


def test_transducer_shares_suffixes_and_keeps_outputs(tmp_path):
    words = sorted(f"{a}{b}ing".encode() for a in "abcdefgh" for b in "xyz")
    path = str(tmp_path / "t.bin")
    with open(path, "wb") as file:
        B.write_transducer(file, [(w, [i, i + 1]) for i, w in enumerate(words)])
    t = B.Transducer(path)
    assert [struct.unpack("<2I", t.ids(w)) for w in words] == [(i, i + 1) for i in range(len(words))]
    assert t.ids(b"ax") is None and t.ids(b"axingo") is None and t.ids(b"") is None
    assert t.root + 1 == 6  # root, after the first letter, i, n, g, end


def test_long_words_merge_alike():
    v = B.Vocabulary(B.default_tokenizer())
    rng = random.Random(1)
    for n in (1, 2, 30, 150, 199, 200):  # up to 200 bytes the other way is taken
        for letters in (b"thequickbrownfox", b"ab", bytes(range(256))):
            word = bytes(rng.choice(letters) for _ in range(n))
            ids = v.merge(word)
            assert v._merge_long(word) == struct.pack(f"<{len(ids)}I", *ids)


def test_very_long_words_equal_the_library(tokenizer, monkeypatch):
    v, rng = B.Vocabulary(B.default_tokenizer()), random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = ["a" * 5001, "ab" * 4000, "ing" * 3000, "".join(rng.choice(letters) for _ in range(20_000)), "".join(rng.choice("the an ion ing er".split()) for _ in range(5000)), "é" * 3000, "".join(rng.choice("aA") for _ in range(9000)), "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(5000))]
    assert v.rising
    for window in (1 << 20, 997):
        monkeypatch.setattr(B, "WINDOW", window)
        for word in words:
            ids = tokenizer.encode(word, add_special_tokens=False).ids
            assert v.packed(word.encode()) == v._merge_long(word.encode()) == struct.pack(f"<{len(ids)}I", *ids)
            assert B.Codec(B.default_tokenizer(), None).decode(struct.pack(f"<{len(ids)}I", *ids)) == word


def peak_mb(code):
    """Peak memory of a process of its own that runs ``code``."""
    import subprocess
    import sys

    end = "\nimport resource; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    done = subprocess.run([sys.executable, "-c", code + end], capture_output=True, text=True, timeout=600, check=True)
    return int(done.stdout.split()[-1])


def test_a_word_of_many_megabytes_stays_below_a_gigabyte():
    head = "import random; from turnlake.llm import bpe_lexicon as B; c = B.Codec(B.default_tokenizer(), None); r = random.Random(1)\n"
    for text in ("'a' * 20_000_000", "''.join(r.choices('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', k=3_000_000))"):
        assert peak_mb(head + f"t = {text}; assert c.decode(c.encode(t)) == t") < 1000


def test_huge_words_are_not_kept(spark, tokenizer):
    huge = ["x" * 300_000 + str(i) for i in range(6)]
    docs = spark.createDataFrame([(i, f"{t} {t} the") for i, t in enumerate(huge)], "doc_id long, text string")
    path = B.default_tokenizer()
    assert {r.word for r in B.frequent_words(B.word_counts(docs, path), 100).collect()} >= {" the"}
    assert all(len(r.word) <= B.WORD_BYTES for r in B.frequent_words(B.word_counts(docs, path), 100).collect())
    codec = B.Codec(path, None)
    for t in huge[:2]:
        codec.encode(t)
    assert all(len(w) <= B.WORD_BYTES for w in codec.known)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert B.token_digests(spark, docs).count() == 0


def test_digest_columns(spark):
    docs = spark.createDataFrame([(5, "the end")], "doc_id long, text string")
    row = B.token_digests(spark, docs).first()
    ids = Tokenizer.from_file(B.default_tokenizer()).encode("the end").ids
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(b"the end").hexdigest()
