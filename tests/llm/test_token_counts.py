import random

import public_tokenizers

from tallywise.llm.token_counts import START, Automaton, _words, token_counts, vocabulary


def greedy(pieces: set[str], longest: int, word: str) -> int:
    s, n, i = START + word, 0, 0
    while i < len(s):
        for k in range(min(longest, len(s) - i), 0, -1):
            if s[i : i + k] in pieces:
                i, n = i + k, n + 1
                break
        else:
            n, i = n + len(s[i].encode()), i + 1
    return n


def test_same_as_greedy_search_on_random_vocabularies():
    r = random.Random(1)
    for _ in range(300):
        pieces = {"".join(r.choice("abc▁") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))}
        automaton = Automaton(sorted(pieces))
        for _ in range(30):
            word = "".join(r.choice("abcé") for _ in range(r.randint(0, 12)))
            assert automaton.count(word) == greedy(pieces, 5, word), (pieces, word)


def test_words_of_a_text_in_slices():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("ab é\t\n\x0b\x0c\r\x1c\x85\xa0") for _ in range(r.choice([0, 1, 5, 60]))).encode()
        for size in (1, 2, 7, 100):
            lists = list(_words(text, size))
            assert [w for own in lists for w in own] == text.split()
            assert all(sum(map(len, own)) <= size + max(map(len, own), default=0) for own in lists)


def test_public_vocabulary_and_edge_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = set(vocabulary(path))
    texts = ["The quick brown fox", "", None, "   \n\t ", "naïve 漢字 xyzzyqj", "a" * 5000 + " the", "The quick brown fox"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, n_words string, lang string")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(df, path).collect()}
    longest = max(map(len, pieces))
    for i, t in enumerate(texts):
        words = (t or "").split()
        assert got[i] == (len(words), sum(greedy(pieces, longest, w) for w in words))
    assert token_counts(df.limit(0), path).count() == 0
