import re

import __spark_entry__ as entry
import corpus_pipeline


def test_one_query_for_each_operator_and_the_pipeline():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", name)) for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
