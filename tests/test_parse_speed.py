"""What reading an office file costs in the interpreter, whatever the machine."""

import sys

from lexflow.plans.files import _archive
from lexflow.sources import ooxml
from lexflow.sources.ooxml import W


def _calls(data: bytes) -> int:
    """Calls of Python functions that the parser's own module makes or takes, for all paragraphs of a file."""
    n = 0

    def count(frame, event, _):
        nonlocal n
        n += event == "call" and frame.f_code.co_filename.endswith(("ooxml.py", "ElementTree.py", "ElementPath.py"))

    sys.setprofile(count)
    try:
        assert sum(1 for _ in ooxml.body_paragraphs(data)) == 500
    finally:
        sys.setprofile(None)
    return n


def test_elements_outside_of_paragraphs_are_not_made_and_those_inside_cost_two_calls():
    """A run of one text is four elements; each costs its start and end, and its text."""
    p = "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>texto</w:t></w:r></w:p>"
    body = "".join(p + f"<w:tbl><w:tr><w:tc>{p}</w:tc></w:tr></w:tbl>" for _ in range(500))
    data = _archive({"word/document.xml": f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'})
    assert _calls(data) < 500 * 32


def test_paragraphs_inside_paragraphs_and_comments():
    inner = "<w:r><w:t>fora</w:t><w:txbxContent><w:p><w:r><w:t>dentro</w:t></w:r></w:p></w:txbxContent></w:r>"
    xml = f'<w:document xmlns:w="{W[1:-1]}"><w:p><w:r><w:t>antes</w:t></w:r></w:p><w:body><w:p>{inner}</w:p><!-- x --><w:p><w:r><w:t>a<!-- y -->b</w:t><w:tab/><w:br/><w:t>c</w:t></w:r></w:p></w:body></w:document>'
    rows = list(ooxml.paragraphs(_archive({"word/document.xml": xml})))
    assert [r["text"] for r in rows] == ["fora", "abc"] and rows[1]["runs"][0]["text"] == "abc\t\n"
