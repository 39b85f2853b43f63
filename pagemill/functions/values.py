"""Values of a matched node: text, inner markup, attribute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``(node, text)`` to a value: the matched node's struct and its stripped text.
ValueFunction = Callable[[Column, Column], Column]
VALUE_FUNCTIONS: dict[str, ValueFunction] = {}

# The characters a Unicode-aware strip removes.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0          "
          "      　")


def strip(value: Column) -> Column:
    """Remove white space at both ends (``trim`` alone would remove blanks only)."""
    return F.btrim(value, F.lit(BLANKS))


def raw_text(node: Column, chunks: Column) -> Column:
    """All text inside the node. Most nodes hold one chunk, which is read in place."""
    size = node["c1"] - node["c0"]
    return (
        F.when(size <= 0, F.lit(""))
        .when(size == 1, F.get(chunks, node["c0"]))
        .otherwise(F.array_join(
            F.transform(F.sequence(node["c0"], node["c1"] - 1), lambda i: F.get(chunks, i)), ""))
    )


def collect_text(node: Column, chunks: Column) -> Column:
    """Text of the subtree, stripped."""
    return strip(raw_text(node, chunks))


def inner_markup(node: Column, html: Column) -> Column:
    """The node's source without its own enclosing tag."""
    return F.substring(html, node["h0"] + 1, node["h1"] - node["h0"])


def collect_attr(node: Column, name: str | Column) -> Column:
    """Value of one attribute, empty when the node lacks it."""
    key = F.lit(name) if isinstance(name, str) else name
    return F.coalesce(F.element_at(node["attrs"], key), F.lit(""))


def register_value(name: str, function: ValueFunction) -> None:
    """Let ``value_functions`` of a spec's element name this function; its values go to a column of their own."""
    if not name:
        raise ValueError("a value function needs a name")
    VALUE_FUNCTIONS[name] = function


def registered_value(name: str, node: Column, chunks: Column) -> Column:
    """The value of a registered function as text, null kept."""
    if name not in VALUE_FUNCTIONS:
        raise ValueError(f"unknown value function {name!r}; registered: {', '.join(sorted(VALUE_FUNCTIONS)) or 'none'}")
    return VALUE_FUNCTIONS[name](node, collect_text(node, chunks)).cast("string")


def csv_field(value: Column, delimiter: str = ",") -> Column:
    """A value quoted for a delimited line where it needs to be; null is empty."""
    text = F.coalesce(value, F.lit(""))
    needs = F.contains(text, F.lit(delimiter)) | text.rlike("[\"\r\n]")
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
