"""Templates that are cut short, or want to grow."""

import pytest
from lustra.llm import chat


def build(source, **scope):
    out = []
    tree = chat.parse(source)

    class Out:
        put = staticmethod(out.append)

    chat._emit(tree)(dict(scope), Out)
    return "".join(out)


@pytest.mark.parametrize("source", ["{{ abcd", "hi {{ abcd", "a {% if x %}b{% endif", "{{ a }} {{", "{% set x = 1", "{{ 'a }"])
def test_unclosed_tags(source):
    with pytest.raises(chat.TemplateError):
        chat.parse(source)


def test_growth_is_bounded():
    doubled = "{% set x = 'ab' %}{% for k in range %}{% set x = x OP x %}{% endfor %}"
    for sign in ("~", "+"):
        with pytest.raises(chat.TemplateError):
            build(doubled.replace("OP", sign), range=list(range(40)))
    with pytest.raises(chat.TemplateError):
        build("{{ 'ab' * 9999999 }}")
    # A text of any length may be framed.
    long = "x" * (3 * chat.LONGEST)
    assert build("{{ '<' ~ text ~ '>' }}", text=long) == f"<{long}>"


def test_what_is_not_there_is_empty():
    assert build("[{{ nothing }}][{{ 'a' ~ nothing ~ 'b' }}][{{ none }}]") == "[][ab][]"


def test_set_in_a_loop():
    assert build("{% set x = 'a' %}{% for k in some %}{% set x = x ~ k %}{{ x }} {% endfor %}{{ x }}", some=["1", "2"]) == "a1 a12 a"
