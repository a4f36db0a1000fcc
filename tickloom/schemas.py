"""Fixed schemas of the raw tables, and their comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType, StringType, StructField, StructType

_KINDS = {"tinyint": ByteType, "smallint": ShortType, "int": IntegerType, "float": FloatType, "double": DoubleType, "string": StringType}


def schema(text: str) -> StructType:
    """A schema from names and types; needs no session."""
    return StructType([StructField(name, _KINDS[kind]()) for name, kind in (c.split() for c in text.split(","))])

RAW = {
    "label": schema("month smallint, sample_id int, target float"),
    "market": schema(
        "sample_id int, seconds_before_predict float, transaction_avgprice float, transaction_volume int, transaction_count int, "
        "ask_price_1 float, ask_volume_1 int, bid_price_1 float, bid_volume_1 int, ask_price_2 float, ask_volume_2 int, bid_price_2 float, bid_volume_2 int"
    ),
    "order": schema("sample_id int, seconds_before_predict float, price float, volume int, side tinyint, order_action tinyint"),
    "transaction": schema("sample_id int, seconds_before_predict float, price float, volume int, side tinyint"),
    "submission": schema("sample_id int, prediction double"),
}
OOF = schema("sample_id int, month smallint, target float, prediction float, fold string")


@dataclass(frozen=True)
class SchemaReport:
    missing_columns: tuple[str, ...]
    extra_columns: tuple[str, ...]
    type_mismatches: tuple[str, ...]
    order_matches: bool

    @property
    def ok(self) -> bool:
        return not (self.missing_columns or self.extra_columns or self.type_mismatches) and self.order_matches


def compare_schema(actual: StructType, expected: StructType) -> SchemaReport:
    have, want = {f.name: f.dataType for f in actual}, {f.name: f.dataType for f in expected}
    return SchemaReport(
        tuple(n for n in want if n not in have),
        tuple(n for n in have if n not in want),
        tuple(n for n in want if n in have and have[n] != want[n]),
        [n for n in have if n in want] == [n for n in want if n in have],
    )
