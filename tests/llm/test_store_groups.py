"""The token store looks up the pieces of several MB of text together; the ids do not depend on that."""

import os

from tests.conftest import SF_SMALL
from tillroll.llm import queries, token_store
from tillroll.llm.common import PIECE


def test_ids_do_not_depend_on_what_is_looked_up_together(spark, scratch, monkeypatch):
    seen, write = [], token_store.write_store
    monkeypatch.setattr(token_store, "write_store", lambda *a, **k: seen.append((a, k)) or write(*a, **k))
    want = sorted(map(tuple, queries.op10_token_store(spark, SF_SMALL).collect()))
    (docs, _, tokenizer, end_id), options = seen[0]
    assert options["together"] >= 4 * PIECE
    for together in (1_000, PIECE):
        path = os.path.join(scratch, str(together))
        write(docs, path, tokenizer, end_id, together=together)
        assert sorted(map(tuple, token_store.read_documents(spark, path).collect())) == want
