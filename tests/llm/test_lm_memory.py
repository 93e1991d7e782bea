import numpy as np

from sparkloom.llm import ngram_lm as lm
from sparkloom.llm.common import Store, worker_cache


def resident(name: str) -> int:
    """Kilobytes of a mapped file that are in this process."""
    found, at = 0, False
    for line in open("/proc/self/smaps"):
        if "-" in line.split()[0] and ":" not in line.split()[0]:
            at = line.rstrip().endswith(name)
        elif at and line.startswith("Rss:"):
            found += int(line.split()[1])
    return found


def test_pages_of_a_model_are_let_go(tmp_path, monkeypatch):
    monkeypatch.setitem(worker_cache(), "mapped", {})
    store = Store(f"file://{tmp_path}")
    store.write("grams", lm.pack([np.arange(1_000_000)]))
    assert int(lm.mapped(store, "grams")[0].sum()) == 499_999_500_000 and resident("grams") > 7_000
    lm.let_go()
    assert resident("grams") > 7_000  # few: kept
    monkeypatch.setattr(lm, "MAPPED_BYTES", 1_000_000)
    lm.let_go()
    assert resident("grams") == 0
    assert int(lm.mapped(store, "grams")[0][-1]) == 999_999


def test_a_bit_says_which_pairs_bear_triples():
    of = np.array([1, 1, 4, 8])
    trie = lm.Trie.__new__(lm.Trie)
    trie.bears = np.packbits(np.bincount(of, minlength=10) > 0, bitorder="little")
    pointers = lm.EliasFano.build(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=10))]))
    pairs = np.arange(10)
    assert trie.fertile(pairs).tolist() == (pointers.access(pairs + 1) > pointers.access(pairs)).tolist()
