import hashlib
import re
import time

import numpy as np
import pytest
from cases import frame, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from textlake.llm import personal_data as pd_

FULL = {
    "email": "re.46@mail8.example.com",
    "ip": "97.51.17.173",
    "card": "4111 1111 1111 1111",
    "phone": "+1 (743) 555-3824",
}


def brute(text):
    """Mentions straight from the stated patterns."""
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(s):
        doubled = [int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(s))]
        return sum(doubled) % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+ ()95", max_size=60))
def test_mentions_equal_the_patterns(text):
    assert pd_.mentions(text) == brute(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([*FULL.values(), "256.1.1.1", "1.2.3.4.5.6.7.8", "a@b@c.de", "4111111111111112", "é", "@", " ", "\n", ","]), max_size=12))
def test_mentions_equal_the_patterns_on_joined_parts(parts):
    text = "".join(parts)
    assert pd_.mentions(text) == brute(text)


def card(i):
    digits = f"4{i * 7919 % 10**6:06d}{i * 104729 % 10**8:08d}"
    return next(digits + str(d) for d in range(10) if pd_._luhn(digits + str(d)))


def texts(n, first=0):
    """Texts with complete mentions, and with numbers that are none."""
    return [
        f"Write to user{i}.{i}@mail{i % 9}.example.com and +1 ({200 + i % 700}) 555-{1000 + 7 * i % 9000}\nfrom 10.{i % 200}.{i % 9}.7 today "
        f"with {card(i)} of 2024, version 4.0, no {i}1234567890123"
        for i in range(first, first + n)
    ]


def rows(texts):
    return [dict(zip(("features", "label", "chain", "skip"), e, strict=True)) for t in texts for e in pd_.examples(t)]


@pytest.fixture(scope="module")
def field():
    return pd_._fitted(rows(texts(200)))


def shown(field, text):
    return [(pd_.KINDS[k], text[a:b]) for a, k, b in pd_.added_spans(text, pd_.mentions(text), field, 0.5)]


@pytest.mark.parametrize(
    ("kind", "short"),
    [("phone", "743-555-3824"), ("phone", "(743) 555-3824"), ("email", "re.46(at)mail8"), ("email", "re.46@mail8"), ("ip", "97-51-17-173"), ("card", "4111.1111.1111.1111")],
)
def test_an_incomplete_form_takes_the_kind_of_the_mention_far_away(field, kind, short):
    far = " and so on" * 300
    assert shown(field, f"First {FULL[kind]}{far}, again {short} there") == [(kind, short)]
    # It repeats nothing here, so that nothing says what it is.
    assert shown(field, f"again {short} there") == []
    if kind == "card":
        return  # a number that passes the card check may be one by itself
    others = " ".join(v for k, v in FULL.items() if k != kind)
    assert shown(field, f"{others}{far}, again {short} there") == []


def test_the_links_decide(field):
    text = "Call +1 (743) 555-3824 or 743-555-3824"
    assert shown(field, text)
    loose = pd_.Field(field.unary, field.chain, field.skip * 0)
    assert pd_.added_spans(text, pd_.mentions(text), loose, 0.5) == []


def sure_of(kind, least_digits=10):
    """A field whose words alone decide: those with so many digits are of one kind, all others are O."""
    field = pd_.Field(np.zeros((pd_.N_FEATURES, 5)), np.zeros((5, 5)), np.zeros((5, 5)))
    field.unary[[i for i, s in enumerate(pd_._SIZES, 1) if s >= least_digits], 1 + pd_.KINDS.index(kind)] = 20.0
    field.unary[0, 0] = 10.0
    return field


def test_a_document_without_mentions_goes_through_the_field(spark):
    text = "again 743-555-3824 there and 12 or (743) 555-3824"
    assert pd_.mentions(text) == []
    assert shown(sure_of("phone"), text) == [("phone", "743-555-3824")]
    got = {r["doc_id"]: r for r in pd_.find(frame(spark, [text, "", "12"]).where("doc_id IS NOT NULL"), sure_of("phone")).collect()}
    assert (got[0]["n_phone"], got[0]["n_added"], got[0]["spans"]) == (0, 1, "phone:6:18")
    assert [got[i]["n_added"] for i in (1, 2)] == [0, 0]


@pytest.mark.parametrize("other", FULL.values())
@pytest.mark.parametrize("text", ["5500.0055.5555.5559 there", "5500_0055_5555_5559 or 5500/0055/5555/5559", "212-333-4567 and 2024-01-02", "jo.12(at)host1 or 10-20-30-456"])
def test_a_mention_that_nothing_repeats_changes_nothing(field, text, other):
    """Whether a document has some mention is no reason to look at its other words or to pass over them."""
    for f in (field, sure_of("card", 8)):
        assert shown(f, f"{other} far from {text}") == shown(f, f"far from {text}")
    assert shown(sure_of("card", 8), f"far from {text}") != []


@pytest.mark.parametrize("n", [3, 200])
def test_a_number_that_passes_the_card_check_is_no_card_by_itself(n):
    field = pd_._fitted(rows(texts(n)))
    for i in range(40):
        number = card(1000 + i)
        for mark in "./_":
            short = mark.join(number[j : j + 4] for j in range(0, len(number), 4))
            # The link decides, with a card of its own far away and without.
            assert shown(field, f"again {short} there") == []
            assert shown(field, f"{FULL['email']} again {short} there") == []
            assert shown(field, f"{number} again {short} there") == [("card", short)]


def test_strangers_of_a_card_pass_its_check():
    luhn = pd_.features("4111.1111.1111.1111")[-1]
    passed = {r["label"] for r in rows(texts(1)) if luhn in r["features"]}
    assert passed == {0, 1 + pd_.KINDS.index("card")}


def test_messages_in_blocks_are_the_same(field, monkeypatch):
    text = f"{FULL['phone']} {FULL['ip']} " + "743-555-3824 97-51-17-173 2024-01-02 and 4111.1111.1111.1111 " * 40
    words = pd_.words_of(text, pd_.mentions(text))
    whole = field.marginals(words)
    for block in (1, 7, 64):
        monkeypatch.setattr(pd_, "BLOCK", block)
        assert np.array_equal(field.marginals(words), whole)


def test_consistency_over_many_repeats(field):
    """A label reaches every occurrence over links between neighbours in the list of repeats; all pairs are not needed."""
    text = "+1 (743) 555-3824 " + "and 743-555-3824 " * 50
    found = shown(field, text)
    assert found == [("phone", "743-555-3824")] * 50
    words = pd_.words_of(text, pd_.mentions(text))
    assert len(words.skip) < 4 * len(words.spans)


def test_a_word_stands_for_all_of_its_mentions(field):
    """However many mentions one word holds, a later incomplete form is linked to each of them."""
    addresses = [f"10.{20 + i}.30.40" for i in range(30)]
    full = ",".join(addresses)
    words = pd_.words_of(full, pd_.mentions(full))
    assert len(pd_.mentions(full)) == 30 and words.observed == [2]
    for address in addresses:
        text = f"{full} and {address[:-3]}"
        assert pd_.words_of(text, pd_.mentions(text)).skip == [(0, 1)], address


def test_mentions_behind_a_long_one_are_seen():
    """A mention over several words is no reason to pass over those that start after it."""
    found = [(0, 3, 30)] + [(i, 0, i + 1) for i in range(2, 14)] + [(20, 1, 24)]
    text = "+1 234567890123 567 " + "9" * 10
    words = pd_.words_of(text, found)
    assert words.observed == [4, 1, 4, 2]


def test_decoys_stay_out(field):
    text = f"{FULL['phone']} then 9807915762804490, CC BY-NC 4.0, version 3.1, (555) 123, 2024-01-02 and 9807915762804490"
    assert shown(field, text) == []


def test_held_out_forms(field):
    right = {}
    for r in rows(texts(100, first=500)):
        z = field.unary[r["features"]].sum(0) + sum(field.chain[n] for n in r["chain"]) + sum(field.skip[n] for n in r["skip"])
        right.setdefault(r["label"], []).append(z.argmax() == r["label"])
    assert set(right) == set(range(5)) and all(sum(v) / len(v) > 0.95 for v in right.values())


def test_nothing_to_learn_from():
    field = pd_._fitted([])
    text = f"{FULL['phone']} 743-555-3824"
    assert pd_.added_spans(text, pd_.mentions(text), field, 0.5) == []


def test_long_runs_take_linear_time():
    started = time.time()
    for text in ["a" * 10**6, "1" * 10**6, "1." * 500_000, "+" * 10**5, "@" * 10**5, "a@" * 10**5, "1 " * 200_000, "-" * 10**6 + "@a.b"]:
        pd_.mentions(text)
        list(pd_._WORD.finditer(text))
    assert time.time() - started < 20


def test_odd_rows(spark, field):
    texts = [*odd_texts(), "\n".join([*FULL.values(), "743-555-3824"]), "x" * 5_000 + " re.46@mail8.example.com"]
    docs = frame(spark, texts)
    got = sorted((r.asDict() for r in pd_.find(docs, field).collect()), key=repr)
    assert len(got) == docs.count()
    of = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        base = brute(t)
        written = ",".join(f"{pd_.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert of[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [of[i][f"n_{k}"] for k in pd_.KINDS] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(filter(None, written.split(","))) <= set(of[i]["spans"].split(",")) or not base
    assert of[len(texts) - 2]["n_added"] == 1 and of[len(texts) - 2]["added"][0]["kind"] == "phone"
    assert pd_.find(docs.limit(0), field).collect() == []
    assert pd_.fit(docs.limit(0)).marginals(pd_.words_of("1", [])).argmax() == 0
    assert pd_.fit(docs).unary.shape == (pd_.N_FEATURES, 5)
