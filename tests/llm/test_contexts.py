"""Whole values in credential contexts."""

import pytest

from vekspar.llm import secrets


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("password: Tr#9!kQz$2w", "Tr#9!kQz$2w"),
        ("token: 12345678:AAEx9kQzLm2vR", "12345678:AAEx9kQzLm2vR"),
        ("the password is x9Kq2vLm8ZtR.", "x9Kq2vLm8ZtR"),
        ("db_pass=x9Kq2vLm8ZtR", "x9Kq2vLm8ZtR"),
        ("export MYSQL_PWD=x9Kq2vLm8ZtR", "x9Kq2vLm8ZtR"),
        ('{"api_key": "x9,Kq<2v Lm8;ZtR", "user": 1}', "x9,Kq<2v Lm8;ZtR"),
        ("secret=x9,Kq;2v<8ZtR,user=joe", "x9,Kq;2v<8ZtR"),
        ("<b>passwd: x9Kq!2vLm8ZtR</b>", "x9Kq!2vLm8ZtR"),
    ],
)
def test_whole_values_are_weighed(text, value):
    assert [text[s:e] for k, s, e in secrets.scan(text) if k == "guess"] == [value]
    assert value not in secrets.clean(text) and value[-4:] not in secrets.clean(text)


def test_nothing_of_a_value_stays_in_clear():
    for text in ("password=abcdef!restOfSecret", "password=monkey!dragon and more"):
        assert "rest" not in secrets.clean(text) and "dragon" not in secrets.clean(text)
    assert secrets.clean("password=monkey!dragon and more").endswith(" and more")


def test_plain_words_are_cheap():
    for w in ("straightforward", "required", "important", "beautiful", "authentication", "unavailable", "configuration"):
        assert [x for x in secrets.scan(f"the login is {w}, and the password is {w}.") if x[0] == "guess"] == [], w
