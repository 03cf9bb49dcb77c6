import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyweave.llm.packing import encoder, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_the_plain_call():
    r = random.Random(0)
    pool = [*(chr(c) for c in range(1, 0x3000) if c % 5 == 0), *" \n\t'" * 60, "'s", "<|endoftext|>", "<|endoftext|", "l'été", "tion"]
    texts = ["", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", *("".join(r.choices(pool, k=r.randrange(60))) for _ in range(3000))]
    t = Tokenizer.from_file(PATH)
    assert [list(x) for x in encoder(PATH)(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert list(encoder(PATH)(["a<|endoftext|>b"])) == [[64, 50256, 65]]
    t.encode_special_tokens = True
    assert [list(x) for x in encoder(PATH, special=False)(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_pieces_cover_every_id_once_and_padding_is_small(spark):
    rows = [(i, ("Some words %d, " % i) * (i * i % 700)) for i in range(120)] + [(500, None), (501, ""), (502, "é\n" * 9000), (502, "same id"), (503, "a <|endoftext|> b")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int").repartition(3)
    found = pack(docs, PATH).collect()
    t = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for d, text in rows:
        ids[d].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    at = defaultdict(int)
    for x in sorted(found, key=lambda x: (x.doc_id, x.doc_tokens, x.start)):
        doc = next(i for i in ids[x.doc_id] if len(i) == x.doc_tokens)
        assert x.start == at[x.doc_id, x.doc_tokens]
        at[x.doc_id, x.doc_tokens] += x.length
        assert x.ids_crc32 == zlib.crc32(doc[x.start : x.start + x.length].tobytes())
    assert dict(at) == {(d, len(i)): len(i) for d, each in ids.items() for i in each}
    bins = defaultdict(list)
    for x in found:
        bins[x.sequence_id].append((x.offset, x.length))
    used = padded = 0
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
        used, padded = used + end, padded + (0 if end & (end - 1) == 0 else 1024 - end)
    assert padded < 0.02 * used
    assert pack(docs.limit(0), PATH).collect() == []
