"""A cut line in a STAR block loses only itself."""

from tomoframe.sources.star import blocks


def test_row_after_a_cut_row_is_kept():
    text = "data_particles\nloop_\n_a\n_b\n_c\n1 2 3\n4 5\n6 7 8\n9\n10 11\n12\n"
    assert blocks(text)[0][2] == [["1", "2", "3"], ["6", "7", "8"], ["9", "10", "11"]]
