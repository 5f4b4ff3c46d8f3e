"""Novelty of secrets: identifiers are left alone, random strings of every alphabet are found; the measure against a plain version."""

import math
import random
import re
import string

import numpy as np
import pytest

from siltstone.llm import secret_scan as S

ALPHABETS = {
    "letters and digits": string.ascii_letters + string.digits, "letters": string.ascii_letters, "small letters": string.ascii_lowercase, "capitals": string.ascii_uppercase, "digits": string.digits,
    "base 32": string.ascii_uppercase + "234567", "base 64": string.ascii_letters + string.digits + "+/", "capital hexadecimal": "0123456789ABCDEF", "punctuation": string.ascii_letters + string.digits + "!@#$%^&*",
}
WORDS = (
    "user profile image large small notification settings controller service request response handler manager account session access refresh client server update delete create build config version default index value "
    "data table column query result error message event listener button panel view model store action payload device network storage region cluster node queue worker task job schedule time date format parse "
    "string number object array list filter sort group merge split join render layout theme color style border margin header footer content article comment author category product order invoice payment customer address shipping discount checkout"
).split()
READABLE = [
    "user_profile_image_2x_large", "NotificationSettingsControllerV2", "images/2024/01/vacation-photo-beach", "/usr/local/lib/python3/site-packages/token", "getElementsByClassName2", "ACCESS_TOKEN_EXPIRE_MINUTES_30",
    "com.example.service.v1.TokenService", "your-api-key-goes-here-please", "xxxxxxxxxxxxxxxxxxxxxxxx", "internationalization2024",
]


def identifiers(n, r):
    for _ in range(n):
        w = [r.choice(WORDS) for _ in range(4)]
        yield r.choice(["_".join(w), "-".join(w), w[0] + "".join(map(str.title, w[1:])), "".join(map(str.title, w))]) + r.choice(["v2", "V2", "_2x", "3", "64", "_01", ""])


def test_readable_identifiers_are_left_alone():
    r = random.Random(3)
    found = lambda x: S.novel_spans(f"the token of {x} is used".encode())
    assert sum(bool(found(x)) for x in READABLE) <= 1, [x for x in READABLE if found(x)]
    assert sum(bool(found(x)) for x in identifiers(1000, r)) <= 50


@pytest.mark.parametrize("name", ALPHABETS)
def test_random_strings_are_found_whole(name):
    r = random.Random(4)
    for length in (16, 24, 40, 200):
        for form in ("Authorization: Bearer {}\n", 'secret is "{}" today'):
            keys = ["".join(r.choice(ALPHABETS[name]) for _ in range(length)) for _ in range(50)]
            hit = 0
            for key in keys:
                text = form.format(key)
                hit += (text.index(key), 3, text.index(key) + length) in S.novel_spans(text.encode())
            assert hit >= 45, (length, form, hit)


def test_digits_need_the_word_right_before_them():
    assert S.novel_spans(b"token: 8305629174450918") and not S.novel_spans(b"a token was given out at the order number 8305629174450918")


def plain_model_share(text: bytes, known) -> float:
    """The character model letter by letter."""
    a = b = S.OTHER
    bits, small = 0.0, False
    for c in text.decode("latin-1"):
        if c in string.ascii_letters:
            if c.isupper() and small:
                a = b = S.OTHER
            s = ord(c.lower()) - 97
            bits += known.bits[a, b, s] + ((S.RAISED if c.isupper() else S.SAME_CASE) if small else S.FREE_CASE)
        elif c in string.digits:
            s = S.DIGIT
            bits += math.log2(10) + (S.NEXT_DIGIT if b == S.DIGIT else S.FIRST_DIGIT)
        else:
            s = S.OTHER
            bits += S.JOINER if c in "_-/.=" else S.PUNCTUATION
        small = c in string.ascii_lowercase
        a, b = b, s
    size = 10 + len({c for c in text.decode("latin-1") if not c.isalnum()})
    for some, every in (("abcdef", string.ascii_lowercase), ("ABCDEF", string.ascii_uppercase)):
        used = {c for c in text.decode("latin-1") if c in every}
        size += 26 if used - set(some) else 6 if used else 0
    return bits / (len(text) * math.log2(size))


def test_measures_against_plain_versions():
    known, r = S.lexicon(), random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(string.ascii_letters + string.digits + "_-/.=!@#$") for _ in range(r.randrange(1, 60))).encode()
        assert math.isclose(S.model_share(text, known), plain_model_share(text, known), rel_tol=1e-9)
    for text in [*READABLE, *identifiers(50, r)]:
        assert math.isclose(S.model_share(text.encode(), known), plain_model_share(text.encode(), known), rel_tol=1e-9)
    assert np.allclose((2.0**-known.bits).sum(2), 1)
    key = b"q8Zr1Lw0Vx7Tn4Gk9Hd2Sb6P"
    assert S.marginal_share(key, b"nothing of it here", known) > 0.95 > S.MIN_MARGINAL_SHARE > S.marginal_share(key, b"before " + key + b" after", known)
    assert S.marginal_share(b"your_password_here", b"", known) < S.MIN_MARGINAL_SHARE
    for x in ("0123456789", string.ascii_lowercase):  # random digits meet their own fours again; so do those they are held against
        assert S.marginal_share("".join(r.choice(x) for _ in range(20_000)).encode(), b"", known) > 0.95


def test_words_are_learned_from_the_whole_corpus(spark):
    """A word that only this corpus knows stops being novel; the learned table is the plain count's, however rows are dealt."""
    word = "zqxvkjwyqzxk"
    text = f"token {word}{word[::-1]}"
    assert S.novel_spans(text.encode())
    other = word[::-1]
    rows = [(i, f"{word} and {other} é{word}") for i in range(60)] + [(100, text), (101, None), (102, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 7):
        known = S.learned_lexicon(docs.repartition(parts))
        assert known is S.lexicon((word.encode(),)) or known.dictionary == S.lexicon((word.encode(),)).dictionary
    found = {x.doc_id: x.spans for x in S.secret_spans(docs).collect()}
    assert len(found) == 63 and found[101] == found[102] == ""
    assert S.learned_lexicon(docs.limit(0)).dictionary == S.lexicon().dictionary


def test_many_context_words_take_linear_time():
    r = random.Random(6)
    key = lambda: "".join(r.choice(string.ascii_letters) for _ in range(20))
    text = "&".join(f"token={key()}" for _ in range(3000))
    found = S.novel_spans(text.encode())
    assert re.sub(r"[^&]", "", text).count("&") == 2999 and len(found) >= 1
    assert len(S.novel_spans(b"token" * 100_000)) == 0
