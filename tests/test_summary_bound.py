"""Bound of the summary document."""

import json

import pytest

from freshet.sources import files


def test_a_part_is_whole_or_refused(spark):
    with pytest.raises(ValueError, match="big"):
        files.summary_document({"small": spark.range(1), "big": spark.range(10_001)})
    assert len(json.loads(files.summary_document({"a": spark.range(10_000)}).first().document)) == 10_000
