"""Identifiers that no seed's form matches, in contexts that seeds induce: recall and false alarms."""

import random

from tracewell.llm import pii

WORDS = "the of and river stone house walks green under small paper night table window letter".split()


def test_unseen_identifiers_behind_contexts_of_seeds(spark, docs_of):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    mail = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(999)}@mail{rng.randrange(50)}.com"
    number = lambda: f"EMP{rng.randrange(10_000, 99_999)}"
    docs, planted = [], {}
    for i in range(400):  # seeds: addresses
        docs.append((i, f"{text(12)} Member contact: {mail()} , {text(10)}"))
    for i in range(400, 520):  # the same place holds numbers of a form that nothing names
        planted[i] = number()
        docs.append((i, f"{text(12)} Member contact: {planted[i]} , {text(10)}"))
    for i in range(520, 560):  # and, at times, words
        docs.append((i, f"{text(12)} Member contact: {rng.choice(WORDS)} , {text(10)}"))
    for i in range(560, 900):  # numbers elsewhere are none
        docs.append((i, f"{text(15)} see {rng.choice(WORDS)} {rng.randrange(100)} , page {rng.randrange(1000)} {text(9)}"))
    by_id = dict(docs)
    assert not any(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in pii.report(docs_of([(i, planted[i]) for i in planted])).collect())
    found = wrong = 0
    for r in pii.report(docs_of(docs)).collect():
        for kind, a, b in (s.split(":") for s in r["spans"].split(",") if s):
            if kind == "email":
                continue
            right = by_id[r["doc_id"]][int(a) : int(b)] == planted.get(r["doc_id"])
            found, wrong = found + right, wrong + (not right)
    assert (found, wrong) == (len(planted), 0)
