"""Operator 13: the template language, its sandbox, and chats formatted and read back."""

import hashlib
import random

import pytest

from sigscan.llm import chatformat
from sigscan.llm.template import Controls, Template, TemplateError

MESSAGES = [{"role": "system", "text": "be"}, {"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a{# no #}b", "ab"), ("{{ 'x' ~ 1 + 1 }}", None), ("{{ 1 + 2 }}{{ 'a' + \"b\\n\" }}", "3ab\n"), ("{{ none }}{{ true and 'y' or 'n' }}", "y"),
        ("{% if 1 == 2 %}a{% elif not false %}b{% else %}c{% endif %}", "b"), ("{% for m in messages %}{{ loop.index }}{{ m.role }}{% if not loop.last %},{% endif %}{% endfor %}", "1system,2user,3assistant"),
        ("x {%- if true -%} y {%- endif -%} z", "xyz"), ("{% set k = 'v' %}{{ k | upper }}{{ (k ~ k) | length }}", "V2"), ("{{ 'a' if 'i' in 'hi' else 'b' }}", "a"),
        ("{% for m in messages %}{% set s = m.text %}{{ s }}{% endfor %}", "behiyo"), ("{{ messages.role }}", ""),
    ],
)
def test_language(source, want):
    if want is None:
        with pytest.raises(TemplateError):
            Template(source)
    else:
        assert Template(source).text(messages=MESSAGES)[0] == want


@pytest.mark.parametrize("source", ["{{ x }}", "{{ messages.__class__.y( }}", "{{ messages | open }}", "{{ ''.join(messages) }}", "{% import os %}", "{% if true %}", "{{ 1 2 }}", "{% endfor %}", "{{ (" + "(" * 200 + "1" + ")" * 201 + " }}", "{% if true %}" * 100 + "{% endif %}" * 100, "{{ not " * 1 + "not " * 200 + "1 }}"])
def test_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_fields_are_keys_only():
    assert Template("{% for m in messages %}{{ m.text.__class__ }}{{ m.keys }}{% endfor %}").text(messages=MESSAGES)[0] == ""


def test_constants_are_folded():
    t = Template("a{{ 'b' ~ 'c' }}{% if 'x' == 'x' %}d{% else %}{{ messages }}{% endif %}{# c #}e{{ ('f' | upper) if true else messages }}")
    assert t.tree == [("text", "abcdeF")]


def test_generation_spans():
    text, spans = Template("{% for m in messages %}<{% generation %}{{ m.text }}{% endgeneration %}>{% endfor %}").text(messages=MESSAGES)
    assert (text, [text[a:b] for a, b in spans]) == ("<be><hi><yo>", ["be", "hi", "yo"])


def test_rendering_takes_messages_one_by_one():
    taken = []

    def endless():
        for k in range(10**9):
            taken.append(k)
            yield {"role": "user", "text": str(k)}

    out = Template(chatformat.TEMPLATE, chatformat.CONTROLS).render(messages=endless())
    for _ in range(1000):
        next(out)
    assert len(taken) < 1000


def test_controls_are_checked():
    for wrong in (["[A]", "[A"], ["<<x>>"], ["["], ["[a\\]"]):
        with pytest.raises(TemplateError):
            Controls(wrong)


def test_escape_is_reversible():
    c, rng = Controls(chatformat.CONTROLS), random.Random(3)
    bits = ["[", "<", "\\", "INST]", "/INST]", "/s>", "s>", "[TEXT]", "\n", "a", "[INST]", "<\\s>"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        safe = c.escape(text)
        assert c.unescape(safe) == text and not c.split.search(safe)
        assert not any(c.split.search(a + safe + b, max(0, len(a) - 6)) and [m.span() for m in c.split.finditer(a + safe + b)] != [(0, len(a)), (len(a + safe), len(a + safe + b))] for a, b in (("[INST]", "[/INST]"), ("<s>", "</s>")))
    assert c.escape("<" * 100_000 + "[" + "\\" * 100_000 + "INST]").count("\\") == 100_001


def test_pieces_are_read_back():
    t, rng = Template(chatformat.TEMPLATE, chatformat.CONTROLS), random.Random(1)
    bits = ["[", "<", "\\", "INST]", "/INST]", "/s>", "s>", "[TEXT]", "[/ROLE]", "\n", "a", "é", "[INST]", "<\\s>", "</s>\n"]
    for _ in range(1500):
        chat = [(rng.choice(["user", "assistant", "system", "", "zz", "[TEXT]", "us[/ROLE]\n"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        for limit in (1, 7, 1 << 18):
            got = list(chatformat.pieces(t.render(messages=iter([{"role": r, "text": x} for r, x in chat])), limit))
            assert list(chatformat.turns([p for p, _ in got], t.controls)) == chat
            assert "".join(t.controls.unescape(p[a:b]) for p, s in got for a, b in s) == "".join(x for r, x in chat if r == "assistant")
    for broken in (["[INST]a"], ["a"], ["[/INST]\n"], ["[INST]a[/INST]"]):
        with pytest.raises(ValueError):
            list(chatformat.turns(broken, t.controls))


def test_odd_rows(spark):
    rows = [(None, 0, None, None), (None, None, "user", "[INST]"), (1, 0, "assistant", "x" * 3_000_000), (1, 0, "assistant", "x" * 3_000_000), (2, 1, "assistant", ""), (2, 0, "tool", "</s>")]
    rows += [(3, k, "assistant" if k % 2 else "user", f"text {k} \\[INST] é") for k in range(5000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, piece int, spans string").repartition(3)
    want = {}
    for conv in {r[0] for r in rows}:
        chat = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv])
        learned = "".join(x for _, _, r, x in chat if r == "assistant")
        want[conv] = (len(chat), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in chat).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    for piece in (1000, chatformat.PIECE):
        formatted = chatformat.format_conversations(df, piece=piece)
        assert {r[0]: tuple(r)[1:5] for r in chatformat.read_back(formatted).collect()} == want
    assert formatted.where("conv_id = 3").count() == 1 and chatformat.format_conversations(df, piece=1000).where("conv_id = 3").count() > 100
    trap = chatformat.chat_round_trip(df.where("false")).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in trap] == [(-7, 2, 21)]
    assert chatformat.read_back(chatformat.format_conversations(df.where("false"))).count() == 0
