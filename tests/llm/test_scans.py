import random
import re

import numpy as np
import pytest

from quadrille.llm import automaton, pii, secrets

ASSIGN = re.compile(secrets._ASSIGN, re.I | re.A)


def brute_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


PARTS = ["password", "passw", "secret", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "AKIA", "ABCDEF0123456789XY", "deadbeef01234567", "abc", "é", "ſ", "K", "PASSWORD", "Tok", "EN", "abcdefghijklmnop", "ghp_", ".", "\n"]


def test_secrets_match_brute_force():
    rng = random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        assert [s for s in secrets.spans(t) if s[1] < 3] == brute_secrets(t), t
    assert secrets.spans(None) == []
    kinds = [secrets.RULES[r].kind for _, r, _ in secrets.spans("é -----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 10 + " xoxb-" + "1" * 20)]
    assert kinds == ["key", "git", "hex", "chat"] or kinds == ["key", "git", "chat", "hex"]


def test_rules_that_give_bytes_back_are_refused():
    with pytest.raises(ValueError):
        automaton.Automaton([automaton.Rule("x", "ab(cd)+")])
    with pytest.raises(ValueError):
        automaton.Automaton([automaton.Rule("x", "a*")])


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute_pii(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_match_brute_force():
    rng = random.Random(6)
    parts = ["a@", "b.c", "@", ".", "1", "22", "255", "256", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "4111111111111111", "x", "é", "1.2.3.4", "..", "00012"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(t) == brute_pii(t), t
    assert pii.luhn([4, 1, 1, 1] + [1] * 12)


def exact_beliefs(g, w):
    """Sum over all labelings."""
    n = len(g.x)
    u = g.x @ w.unary.T
    total = np.zeros((n, 5))
    for labels in np.ndindex(*[5] * n):
        if any(s >= 0 and s != y for s, y in zip(g.seen, labels)):
            continue
        e = sum(u[i, y] for i, y in enumerate(labels)) + sum(w.chain[labels[a], labels[b]] for a, b in g.chain) + sum(w.skip[labels[a]] for a, b in g.skip if labels[a] == labels[b])
        for i, y in enumerate(labels):
            total[i, y] += np.exp(e)
    return total / total.sum(axis=1, keepdims=True)


def test_messages_are_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(3)
    w = pii.Field(rng.normal(size=(5, pii.N_FEATURES)) * 0.3, rng.normal(size=(5, 5)) * 0.3, np.abs(rng.normal(size=5)) * 0.5)
    for text, tolerance in (("12 word 12 word 34 99", 1e-3), ("77 12 x 12 77 a 12", 0.05)):
        g = pii.graph([text], [[]])
        assert len(g.skip) > 0
        assert np.abs(pii.beliefs(g, w, rounds=100) - exact_beliefs(g, w)).max() < tolerance


def test_a_label_spreads_to_repeated_mentions():
    train = [f"call +1 (2{i}4) 555-7{i}13 now or write a{i}@b.com from 10.0.{i}.1 total {i}3 items" for i in range(10)]
    w = pii.fit(train)
    text = "reach +1 (555) 555-9876 today. word word 555-9876 again"
    (base, spans), = pii.all_spans([text], w)
    assert [text[a:z] for _, a, z in base] == ["+1 (555) 555-9876"]
    assert "555-9876" in [text[a:z] for k, a, z in spans if (k, a, z) not in base]
    (base, spans), = pii.all_spans(["chapter 3. of 12 with 7 parts"], w)
    assert base == spans == []


def test_a_label_reaches_a_hundred_mentions():
    w = pii.fit([f"call +1 (2{i}4) 555-7{i}13 now or write a{i}@b.com from 10.0.{i}.1 total {i}3 items" for i in range(10)])
    text = "reach +1 (555) 555-9876 today. " + " ".join(f"word{'x' * (k % 5)} 555-9876 again" for k in range(100))
    (base, spans), = pii.all_spans([text], w)
    assert len(base) == 1 and sum(text[a:z] == "555-9876" for _, a, z in spans) == 100


def test_spans_do_not_depend_on_the_batch():
    w = pii.fit([f"call +1 (2{i}4) 555-7{i}13 now or write a{i}@b.com from 10.0.{i}.1 total {i}3 items" for i in range(10)])
    rng = random.Random(8)
    parts = ["555-9876", "+1 (555) 555-9876", "12", "a@b.cc", "mail", "1.2.3.4", "1.2.3.999", "x", "4111 1111 1111 1111", "9876", "."]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    assert pii.all_spans(texts, w) == [pii.all_spans([t], w)[0] for t in texts]


def test_tables(docs, odd):
    rows = [*odd, (60, "a@b.cc and 1.2.3.4", "en", "s"), (61, "token = \"0123456789abcdef01\"", "en", "s")]
    found = {r["id"]: r for r in pii.pii_spans(docs(rows)).collect()}
    assert (found[60]["n_email"], found[60]["n_ip"], found[60]["spans"]) == (1, 1, "email:0:6,ip:11:18")
    assert found[1]["spans"] == "" and len(pii.pii_spans(docs(rows)).collect()) == len(rows)
    got = {r["id"]: r for r in secrets.secret_spans(docs(rows)).collect()}
    assert (got[61]["n_assign"], got[61]["n_hex"], got[61]["spans"]) == (1, 1, "assign:0:27,hex:9:27")
    text = {r["doc_id"]: r["text"] for r in pii.masked(docs(rows)).collect()}
    assert text[60] == "[email] and [ip]" and text[1] is None and text[9] == "two words"
    assert pii.pii_spans(docs([])).count() == secrets.secret_spans(docs([])).count() == pii.masked(docs([])).count() == 0
