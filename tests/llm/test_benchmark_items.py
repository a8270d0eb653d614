"""Every text of the benchmark is searched, whatever ids the texts have."""

import random

from cohortline.llm import leaks

from .conftest import frame, prose
from .test_texts import leaks_of


def test_all_texts_of_an_item_are_searched(spark):
    rng = random.Random(12)
    long = sorted(prose(rng, 20) for _ in range(8))
    # two texts of one id, a short and an empty least one, texts without an id, exact repeats
    items = [(1, long[0]), (1, long[1]), (2, "a b"), (2, long[2]), (3, ""), (3, long[3]), (4, None),
             (4, long[4]), (None, long[5]), (None, long[6]), (None, None), (5, long[7]), (5, long[7])]
    rows = [(i, prose(rng, 15) + " " + text + " " + prose(rng, 6)) for i, text in enumerate(long)]
    rows += [(20, long[0] + " " + long[1]), (21, prose(rng, 60))]
    got = leaks.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    found = [(r.doc_id, r.item_id) for r in got.collect()]
    assert len(found) == len(set(found)) == 9
    assert set(found) == leaks_of(rows, items)
