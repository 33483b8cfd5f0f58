"""The encoder keeps a bounded number of pieces, the ones that come up again, and cuts texts as Arrow columns."""

import pyarrow as pa
from tokenizers import Tokenizer

from vecloom.llm.common import give_back, process_cache
from vecloom.llm.queries import tokenizer_path
from vecloom.llm.token_files import Encoder


def test_pieces_that_come_up_again_outlive_the_others_and_ids_stay_those_of_the_tokenizer():
    whole, coder = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path(), keep=60)
    often = " the same words, again and again: über 12 don't"
    for n in range(12):
        texts = [f"w{n}" + often, None, "", f"  two  spaces\n\nand lines {n} ", f" only{'abcdefghijkl'[n]} x￿y\ttab ", "".join(f" {chr(97 + k)}{chr(97 + n)}q" for k in range(26))]
        ids, lengths = coder.encode(pa.array(texts, pa.string()))
        assert lengths.tolist() == [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]
        assert ids.tolist() == [i for t in texts for i in whole.encode(t or "", add_special_tokens=False).ids]
        assert len(coder.number) <= 60 + 80
    coder._make_room()
    assert {" the", " same", " words,", " again", " über"} <= set(coder.number) and len(coder.number) <= 60


def test_a_worker_that_turns_to_other_work_gives_the_encoders_back():
    kept = process_cache("encoders-of-a-test")
    kept["path"] = object()
    give_back("encoders-of-a-test")
    assert not kept and process_cache("encoders-of-a-test") is kept
