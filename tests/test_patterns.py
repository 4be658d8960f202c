import pytest

from raregram.functions.patterns import fragments, keys, normalise
from raregram.options import GramOptions


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("abc", ["$abc$"]), ("a_c", ["$a", "c$"]), ("%x y%", ["x$", "$y"]), ("%, abc%", ["$abc"]), ("\\_abc\\_", ["$abc$"]), ("%", []), ("", []), ("_", []),
        ("%\\abc%", ["abc"]), ("abc\\%def", ["$abc$", "$def$"]), ("abc\\\\%def", ["$abc$", "def$"]), ("%ABC", ["abc$"]), ("%aé%", ["a$"]), ("%\u212ab%", ["$b"]),
    ],
)
def test_fragments(pattern, want):
    assert fragments(pattern) == want


def test_escape_characters():
    assert fragments("$$the$$", "$") == ["$the$"]
    assert normalise("$_a$$%", "$") == "\\_a$%"
    assert normalise("%\\abc%") == "%abc%"
    assert normalise("a!b\\", "!") == "ab\\\\"
    assert normalise("a\\b", "") == "a\\\\b"
    with pytest.raises(ValueError):
        normalise("a\\")
    with pytest.raises(ValueError):
        normalise("a", "xy")


def test_keys():
    assert keys("%indexing%", GramOptions(3, 3)) == ["dex", "exi", "ind", "ing", "nde", "xin"]
    assert keys("%zz%", GramOptions(3, 3)) == []
    assert keys("%ab%", GramOptions(2, 4, ("abc",))) == []
