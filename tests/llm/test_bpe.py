import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cytolake.llm.bpe import Codec, Vocabulary, default_path
from cytolake.llm.lexicon import Lexicon, compile_words


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def codec():
    v = Vocabulary(default_path())
    words = ["the", "of", "hello", "été", "thand", "'s", "!!", "12"]
    entries = {w.encode(): tuple(v.merged(w.encode())) for w in words}
    return Codec(v, Lexicon.mapped(compile_words(entries)))


def same(codec, library, texts):
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, repr(text)
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False), repr(text)


def test_edge_texts(codec, library):
    same(codec, library, ["", " ", "a", "Hello WORLD", "it's I'LL it'S", "a\x1c,b", "a\x1d b\x1e", "Σας ΑΣ", "x<|endoftext|>y", "<|startoftext|> <|endoftext|>", "<|ENDOFTEXT|>", "1234 ١٢", "İ ı ß ẞ", "é ́", "a" * 3000, "ab" * 1000 + "!" * 999, " x​y z", "thand the of été"])


def test_every_character(codec, library):
    """The code points of alphabets and symbols, between letters and next to punctuation."""
    step = 257
    points = [chr(c) for c in range(1, 0x20000) if not (0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xF900)]
    texts = ["".join(f"a{c}, {c}b " for c in points[i : i + step]) for i in range(0, len(points), step)]
    same(codec, library, texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abAB'st lLvérÉ12!?,.\n\t\x1ćΣσ<|>"), max_size=60))
def test_random_texts(codec, library, text):
    same(codec, library, [text])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcdeilnorstuy'!,é", min_size=1, max_size=40), max_size=30))
def test_words_merged_together_are_merged_as_one_by_one(codec, words):
    raw = [w.encode() for w in words]
    assert codec.v.merged_many(raw) == [codec.v.merged(w) for w in raw]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), max_size=3).map(tuple), max_size=40), st.lists(st.binary(max_size=6), max_size=10))
def test_lexicon_holds_its_words_and_no_others(entries, others):
    lexicon = Lexicon.mapped(compile_words(entries))
    words = [*entries, *others]
    for word, rank in zip(words, lexicon.ranks(words).tolist(), strict=True):
        assert (rank >= 0) == (word in entries)
        assert rank < 0 or tuple(lexicon.ids_of(rank)) == entries[word]


def test_long_texts_are_cut_at_white_space_only(codec, library, monkeypatch):
    """Chunks of a few characters give the same ids, whatever the text."""
    from cytolake.llm import bpe

    monkeypatch.setattr(bpe, "CHUNK", 7)
    texts = ["", "été the of thand it's 12 <|endoftext|>x y" * 5, "a" * 40, " \n ", "the of", "hello, hello! hello"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert codec.encode(texts) == want


def test_a_full_memory_changes_no_ids(codec, library):
    small = Codec(codec.v, codec.lexicon, memory=3)
    for _ in range(3):
        same(small, library, ["zork plugh xyzzy frob quux it's", "the of blorb zork naïve Ünïcødé"])


def test_digests_are_those_of_the_ids_and_of_the_decoded_text(codec, library):
    import hashlib

    texts = ["", "  ", "Hello the world!! été", "<|endoftext|>", "x" * 100 + " y"]
    for text, (n, ids, decoded, _) in zip(texts, codec.results(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert n == len(want)
        assert ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert decoded == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_codecs_of_two_vocabularies_are_told_apart(tmp_path, codec):
    """Also where their lexicons are the same."""
    import json
    from types import SimpleNamespace

    from cytolake.llm import bpe

    spec = json.load(open(default_path(), encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][:100]
    (tmp_path / "other.json").write_text(json.dumps(spec))
    empty = SimpleNamespace(value=compile_words({}))
    found = []
    for path in (default_path(), str(tmp_path / "other.json")):
        shared = bpe.Shared.__new__(bpe.Shared)
        shared.vocabulary, shared.lexicon = SimpleNamespace(value=Vocabulary(path)), empty
        found.append(bpe.shared_codec(shared).encode(["something"])[0])
    assert len(found[0]) < len(found[1])
