import json

import public_tokenizers
import pytest

from weftline.llm.token_counts import Counter


@pytest.mark.parametrize("part, change", [
    ("model", {"dropout": 0.1}), ("model", {"byte_fallback": True}), ("model", {"ignore_merges": True}), ("model", {"end_of_word_suffix": "</w>"}),
    ("token", {"lstrip": True}), ("token", {"rstrip": True}), ("token", {"single_word": True}),
])
def test_files_that_count_otherwise_are_refused(part, change):
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        spec = json.load(f)
    Counter(json.dumps(spec).encode())
    (spec["model"] if part == "model" else spec["added_tokens"][0]).update(change)
    with pytest.raises(ValueError, match=next(iter(change))):
        Counter(json.dumps(spec).encode())
