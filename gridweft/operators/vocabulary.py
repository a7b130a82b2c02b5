"""Symbols to numbers and back-checks against an alphabet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The symbols of table structures, in order.
STRUCTURE_SYMBOLS = (
    "<thead>", "<tr>", "<td></td>", "</tr>", "</thead>", "<tbody>", "<eb></eb>", "</tbody>", "<td",
    ' colspan="5"', ">", "</td>", ' colspan="2"', ' colspan="3"', "<eb2></eb2>", "<eb1></eb1>",
    ' rowspan="2"', ' colspan="4"', ' colspan="6"', ' rowspan="3"', ' colspan="9"', ' colspan="10"',
    ' colspan="7"', ' rowspan="4"', ' rowspan="5"', ' rowspan="9"', ' colspan="8"', ' rowspan="8"',
    ' rowspan="6"', ' rowspan="7"', ' rowspan="10"', "<eb3></eb3>", "<eb4></eb4>", "<eb5></eb5>",
    "<eb6></eb6>", "<eb7></eb7>", "<eb8></eb8>", "<eb9></eb9>", "<eb10></eb10>",
)
MAX_SYMBOLS = 500
MAX_LABEL = 75
MODEL_WORDS = 1024


def structure_tokens(markup: Column | str) -> Column:
    """Structure symbols of a table: empty cells in one symbol, span attributes on their own, no cell text."""
    m = F.col(markup) if isinstance(markup, str) else markup
    m = F.regexp_replace(m, r"(?s)(<t[dh][^>]*>).*?(?=</t[dh]>)", "$1")
    m = F.regexp_replace(F.regexp_replace(m, r"<th(?=[\s>])", "<td"), r"</th>", "</td>")
    pattern = r"<td></td>|<td(?=\s)|\s(?:colspan|rowspan)=\"[0-9]+\"|</?[a-z][a-z0-9]*>|>"
    return F.regexp_extract_all(m, F.lit(pattern), F.lit(0))


def encode(tokens: Column | str, symbols: tuple[str, ...] | list[str], max_length: int = MAX_SYMBOLS) -> Column:
    """Fixed-length code array: start, symbols, end, padding; unknown symbols share one code.

    Codes: 0.. for the symbols, then unknown, start, end, padding.  Longer inputs are cut to
    ``max_length`` codes including start and end.
    """
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    n = len(symbols)
    codes = F.create_map(*[F.lit(x) for i, s in enumerate(symbols) for x in (s, i)])
    body = F.transform(
        F.slice(tokens, 1, max_length - 2), lambda t: F.coalesce(F.try_element_at(codes, t), F.lit(n))
    )
    coded = F.concat(F.array(F.lit(n + 1)), body, F.array(F.lit(n + 2)))
    return F.concat(coded, F.array_repeat(F.lit(n + 3), F.lit(max_length) - F.size(coded)))


def outside_alphabet(tokens: DataFrame, alphabet: DataFrame, column: str = "token") -> DataFrame:
    """Distinct tokens that the alphabet does not contain, with their counts."""
    counts = tokens.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(alphabet.select(column), column, "left_anti")


def structure_alphabet(spark) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(STRUCTURE_SYMBOLS)], "token string, code int")


def first_words(text: Column | str, limit: int = MODEL_WORDS) -> Column:
    """The first ``limit`` words of a text, as a text model takes them, joined by single spaces."""
    words = F.filter(F.split(F.col(text) if isinstance(text, str) else text, r"[ \t\n\x0b\f\r]+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, limit), " ")


def within_length(df: DataFrame, column: str, limit: int = MAX_LABEL) -> DataFrame:
    """Rows whose text has at most ``limit`` characters."""
    return df.filter(F.length(column) <= limit)
