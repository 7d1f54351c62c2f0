"""Merged misses are kept within a bound in bytes, and those that come again stay."""

import base64
import random

import public_tokenizers

from auditloom.llm import byte_bpe


def _plain(ranks, piece):
    ids = [bytes([b]) for b in piece]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a + b in ranks]:
        _, i = min(pairs)
        ids[i : i + 2] = [ids[i] + ids[i + 1]]
    return b"".join(ranks[x].to_bytes(4, "little") for x in ids)


def test_misses_are_bounded_in_bytes_and_merged_once(monkeypatch):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    monkeypatch.setattr(byte_bpe, "KEPT_BYTES", 200_000, raising=False)
    coder, merged, merge = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN), [], byte_bpe.ByteBpe.merge
    monkeypatch.setattr(coder, "merge", lambda piece: merged.append(piece) or merge(coder, piece))
    draw = random.Random(5)
    for _ in range(60):
        long = "".join(draw.choices("abcdefgh", k=6000))
        assert coder.packed_ids([f"{long} whenthongre"])[0].endswith(_plain(ranks, b" whenthongre"))
    assert merged.count(b" whenthongre") == 1 and len(merged) == 61
    kept = sum(len(k) + len(v) for held in (coder.misses, getattr(coder, "older", {})) for k, v in held.items())
    assert kept < 2 * 200_000


def test_merges_match_a_plain_search():
    draw = random.Random(7)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 700:
        a, b = draw.choice([*ranks][97:102] + [*ranks][256:]), draw.choice([*ranks][97:102] + [*ranks][256:])
        ranks.setdefault(a + b, len(ranks) + 3)  # numbers with a gap
    keys = [*ranks][256:]
    numbers = [ranks[k] for k in keys]
    draw.shuffle(numbers)  # a pair may join to a lower number than its parts have
    ranks |= dict(zip(keys, numbers))
    coder = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    for n in [*range(1, 20)] * 20 + [300]:
        piece = bytes(draw.choices(range(96, 103), k=n))
        assert coder.merge(piece) == _plain(ranks, piece)
