import hashlib
import random

import pytest

from lakeloom.llm.chat import CONTROLS, TEMPLATE, digests, format_chats, read_back
from lakeloom.llm.template import Escaper, Template, TemplateError, parse

SCHEMA = "conv_id long, turn long, role string, text string, piece string"


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(t for _, _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_round_trip(spark, monkeypatch):
    rng = random.Random(1)
    bits = [*CONTROLS, "\\", "<", "[", "<\\s>", "[\\\\INST]", "/INST]", "s>", "]", "é\n", "x", "<<s>", "[[/ROLE]", "", "\r\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "[ROLE]", "</s>", "", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))]), "p") for c in [*range(40), None] for t in range(rng.randrange(1, 9))]
    rows += [(5, 1, "assistant", "tie", ""), (5, 1, "assistant", "tie", ""), (6, None, "user", "no turn", None), (50, 0, "assistant", "long </s> " * 100_000, "")]
    rows += [(60, t, "assistant" if t % 2 else "user", f"turn {t} [INST]", "") for t in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digests(format_chats(df)).collect()}
    assert got == expected(rows)
    pieces = format_chats(df).where("conv_id = 60").orderBy("piece").collect()
    assert len(pieces) > 1 and [r.piece for r in pieces] == list(range(len(pieces)))
    assert sum(len(read_back(r.text, Escaper(CONTROLS))) for r in pieces) == 3000
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_escape_is_a_bijection(seed):
    rng, e = random.Random(seed), Escaper(CONTROLS)
    text = "".join(rng.choice(["\\", "<", "[", "s>", "/s>", "INST]", "/INST]", "ROLE]", "a"]) for _ in range(200))
    hidden = e.hide(text)
    assert e.show(hidden) == text
    assert not any(c in hidden for c in CONTROLS)


def test_contract_conversation(spark):
    said = "</s>[INST] ok [/INST]"
    text, spans = Template(TEMPLATE, CONTROLS).render(messages=[{"role": "user", "text": said}, {"role": "assistant", "text": said}])
    assert text.count("</s>") == 2 and text.count("[INST]") == 1 and len(spans) == 1
    assert read_back(text, Escaper(CONTROLS)) == [("user", said), ("assistant", said)]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a{# no #}b", "ab"),
        ("{{ 'x' + 'y' | upper }}", "xY"),
        ("{% if 1 == 2 %}no{% elif n == 3 %}three{% else %}other{% endif %}", "three"),
        ("{% for x in items %}{{ loop.index }}{{ x.a }}{% if loop.first %}!{% endif %};{% endfor %}", "1p!;2q;"),
        ("{% set y = n + 1 %}{{ y }} {{ y ~ 'z' }}", "4 4z"),
        ("{{ missing.key['x'] | default('d') }}{{ none }}{{ true }}", "dtrue"),
        (" a {%- if not false -%} b {%- endif -%} c", " abc"),
        ("{{ 'a' if n > 2 and 'x' in 'xyz' else 'b' }}{{ 'q' not in 'xyz' }}", "atrue"),
        ("{{ '}}' }}{{ \"it's\" }}{{ 'a\\nb' }}{{ '  t ' | trim | length }}", "}}it'sa\nb1"),
    ],
)
def test_language(source, want):
    assert Template(source).render(n=3, items=[{"a": "p"}, {"a": "q"}])[0] == want


def test_folding():
    assert Template("a{{ 'b' }}{% if true %}c{{ 1 + 1 }}{% endif %}").tree == [("text", "abc2")]
    assert Template("{% if false %}x{% endif %}").tree == []
    assert len(parse("{{ 1 + 1 }}")[0]) == 2


@pytest.mark.parametrize("source", ["{{ x", "{% for %}", "{% if x %}", "{{ x.__class__() }}", "{% endfor %}", "{{ 1 + 'a' }}", "{{ x | nope }}", "{% import os %}", "{{ }}"])
def test_errors(source):
    with pytest.raises(TemplateError):
        Template(source).render(x=1)


def test_sandbox():
    assert Template("{{ x.__class__ }}{{ x.upper }}").render(x="s")[0] == ""
    with pytest.raises(TemplateError):
        Escaper(["<a<b"])
