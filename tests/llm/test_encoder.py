import random

import public_tokenizers
from edgeloom.llm import binout


def test_stretches_apart_give_the_ids_of_whole_texts():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        machine = binout.Encoder(f.read())
    assert machine.apart
    rng = random.Random(1)
    parts = list(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x85\xa0　'sdaAΣσİ̸́é<>|1٣中가`=​**..##%,ßÿ÷×") + ["<|endoftext|>", "<|startoftext|>", "'ll", "don't", " ", "x" * 50]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    assert machine.ids(texts) == machine.whole(texts)
    assert all(len(x) <= binout.LONGEST_REMEMBERED for x in machine.seen)
