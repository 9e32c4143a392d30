"""Operator 3 prices and masks whole values, in quotes and without."""

import random
import string
import time

from lodestone.llm import secret_scan


def masked(text):
    return secret_scan.mask(text, secret_scan.scan(text))


def test_values_in_quotes_are_whole():
    assert masked('password = ";~_hi_Ut6@t6eT#x" end') == 'password = "[SECRET]" end'
    assert masked("{'api_key': 'a,b;c<d>{e}(f)[g]9Q', 'n': 1}") == "{'api_key': '[SECRET]', 'n': 1}"
    assert masked('"auth":{"user":"bob","password":"p;Q r9#x Lw2@"}') == '"auth":{"user":"bob","password":"[SECRET]"}'
    assert masked('token="x8Kq2\\"vLw9TzR" b="c"') == 'token="[SECRET]" b="c"'
    rng = random.Random(3)
    marks = [c for c in string.printable[:94] if c not in "\"\\"]
    for _ in range(2000):
        value = "".join(rng.choices(marks, k=16))
        # the base pattern's span has the name in it
        assert masked(f'password = "{value}" and on') in ('password = "[SECRET]" and on', '[SECRET]" and on'), value


def test_values_without_quotes_go_up_to_a_blank():
    assert masked("pwd: q;W(8)z<K>[v]{t},9L. Next") == "pwd: [SECRET]. Next"
    assert masked('(secret=x8Kq2,vLw9TzR), so') == "(secret=[SECRET]), so"
    assert masked('secret: "x8Kq2,vLw9TzR') == 'secret: "[SECRET]'
    # a short value may be the name of the next one
    assert masked("secret:token = x8Kq2vLw9TzR") == "secret:token = [SECRET]"
    assert masked('pwd = "qwerty" and token: ""') == 'pwd = "qwerty" and token: ""'


def test_time_stays_linear():
    began = time.time()
    for text in ("token:" * 10_000, 'token:"' * 10_000, 'token="a' * 10_000, "token:{" * 10_000):
        secret_scan.scan(text)
    assert time.time() - began < 30
