"""Every kind of personal data beyond the lengths and spellings that patterns are often cut to."""

import random
import re

import pytest

from fallpoint.llm import pii

rng = random.Random(12)
draw = lambda letters, n: "".join(rng.choices(letters, k=n))
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
LONG = {
    "quoted": ('token = "%s"', draw(LETTERS, 300)), "bare": ("token=%s end", draw(LETTERS, 300)), "jwt": ("auth: %s", ".".join(draw(LETTERS, 2000) for _ in range(3))),
    "huge": ("secret=%s", draw(LETTERS, 50_000)), "sk": ("use %s now", "sk-" + draw(LETTERS, 158)), "sk_letters": ("use %s now", "sk-" + draw("abcdefgh", 30)),
    "sk_dash": ("use %s- now", "sk-" + draw(LETTERS, 150)), "xox": ("use %s now", "xoxb-" + draw(LETTERS, 200)), "ghp": ("use %s now", "ghp_" + draw(LETTERS, 60)),
    "hex": ("key %s.", "a1" + draw("0123456789abcdef", 126)), "name": ("Frau %s kam", "W" + draw("abcdefgh", 40))}
FORMS = ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "::1", "2001:db8::", "1:2:3:4:5:6:7:8", "030 12345678", "01 23 45 67 89", "0171-1234567", "089/123456", "(030) 12345678",
         "020 7946 0958", "3782 822463 10005", "3782-822463-10005", "3056 930902 5904"]
CLEAN = ["std::vector abc::def", "on 01-02-2020 at 10:30:15", "0.5 of 100 000", "from 2001 to 2010"]


@pytest.fixture(scope="module")
def out(spark):
    rows = {**{k: shape % value for k, (shape, value) in LONG.items()}, **{f: f"see {f}, please" for f in FORMS}, **{c: c for c in CLEAN},
            "mapped": "at ::ffff:97.51.17.173 now", "spelt": "2001:db8::1 2001:0DB8:0:0:0:0:0:1 2001:db8::2"}
    return {r["k"]: (r["text"], r["n"]) for r in pii.pseudonymise(spark.createDataFrame(list(rows.items()), "k string, text string"), "k", id_col="k", count_col="n").collect()}


@pytest.mark.parametrize("kind", LONG)
def test_whole_secret_is_replaced(out, kind):
    shape, value = LONG[kind]
    new, n = out[kind]
    head, tail = shape.split("%s")
    assert n == 1 and new.startswith(head) and new.endswith(tail)
    made = new[len(head):len(new) - len(tail)]
    assert all(value[k:k + 12] not in made for k in range(0, len(value) - 12)) and (kind == "name" or len(made) == len(value))


@pytest.mark.parametrize("form", FORMS)
def test_form_is_replaced(out, form):
    new, n = out[form]
    assert n == 1 and form not in new and re.fullmatch(r"see [0-9a-f:()/ -]+, please", new)


def test_no_more_than_that(out):
    assert all(out[c] == (c, 0) for c in CLEAN)
    assert out["mapped"][1] == 1 and "97.51.17.173" not in out["mapped"][0]


def test_spellings_of_an_address_are_one(out):
    first, second, third = out["spelt"][0].split()
    assert first == second.lower() != third and out["spelt"][1] == 3


NAMES = ["Mr. John Paul Smith", "Mrs. Anne-Marie Lee", "Dr. O'Neil", "Mr. McDonald", "Prof. J. R. R. Tolkien", "Herr Ludwig van der Berg", "Ms SMITH-JONES", "Mr. Émile D’Arcy"]


def made_of(spark, texts):
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k", id_col="k", count_col="n").collect()
    return [(r["text"], r["n"]) for r in sorted(got)]


def test_whole_names(spark):
    title = re.compile(r"^(?:Mrs|Ms|Mr|Dr|Prof|Herr)\.? ")
    for name, (new, n) in zip(NAMES, made_of(spark, [f"then {x} came" for x in NAMES])):
        head = title.match(name).group(0)
        assert n == 1 and new.startswith(f"then {head}") and new.endswith(" came")
        rest = new[5 + len(head):-5].split(" ")
        assert len(rest) == len(name[len(head):].split(" "))
        for word, own in zip(rest, name[len(head):].split(" ")):
            assert (word == own) == (own in pii.PARTICLES) or own.endswith(".") and word.endswith(".")
            assert own == own.lower() or word[0].isupper()


def test_one_person_written_twice(spark):
    (new, n), = made_of(spark, ["Mr. McDonald, Mr. Mcdonald, Mr. McAllister and Mr. Ian McAllister"])
    a, b, c, d = re.findall(r"Mr\. ([A-Z][a-z]+(?: [A-Z][a-z]+)?)", new)
    assert n == 4 and a == b and c != a and d.split(" ")[1] == c


def test_addresses_of_any_length(spark):
    long = ["a" * 70 + "@b.org", "x@" + "c" * 80 + ".org", "x@" + ".".join(["d"] * 500) + ".org", "e" * 100_000 + "@f.org"]
    for address, (new, n) in zip(long, made_of(spark, [f"to {x}." for x in long])):
        assert n == 1 and address.split("@")[0] + "@" not in new.replace("x@", "") and new.endswith(".example.") and len(new.split("@")[0]) == 3 + len(address.split("@")[0])


def valid(account):
    account = re.sub(" ", "", account)
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def test_account_numbers_keep_their_check(spark):
    good = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606"]
    for account, (new, n) in zip(good, made_of(spark, [f"pay {x} now" for x in good])):
        assert n == 1 and valid(account) and valid(new[4:-4]) and new[4:-4] != account and [c == " " for c in new[4:-4]] == [c == " " for c in account]
    (new, n), = made_of(spark, ["pay DE88370400440532013000 now"])
    assert n == 1 and "370400440532013000" not in new
