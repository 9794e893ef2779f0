"""The snapshot tables conform to their declared schemas."""

from __future__ import annotations

import pytest

from opslens.sources.schemas import NAMES, SchemaError, conform, schema


@pytest.mark.parametrize("name", sorted(NAMES))
def test_fixture_conforms(snap_small, name):
    df = getattr(snap_small, name)
    out = conform(df, name)
    got = [(f.name, f.dataType) for f in out.schema.fields]
    assert got == [(f.name, f.dataType) for f in schema(name).fields]


def test_conform_rejects_missing_and_narrowing(spark):
    df = spark.createDataFrame([(1, "x")], "con_id bigint, name string")
    with pytest.raises(SchemaError, match="con_id: bigint is not int"):
        conform(df, "containers")
    with pytest.raises(SchemaError, match="missing name"):
        conform(spark.createDataFrame([(1,)], "con_id int"), "containers")
