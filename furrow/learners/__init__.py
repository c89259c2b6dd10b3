"""Learners written as sums over blocks of rows, and a predictor for each.

A learner never sees the table: it asks for sums of functions of blocks (``blocks.Held``, one array
of proven small size; ``blocks.Spread``, a table whose tasks sum their own blocks and merge in a
tree) and steers by them. Both give the same model but for the order in which doubles are added."""
