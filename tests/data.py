"""Small made-up inputs that hit the edge cases."""

INDEX_LINES = ["cat 1 2 3 5", "car 2 4", "dog 2 3 6", "bird 3", "a 1 2 4"]

INDEX = {
    line.split()[0]: {int(i) for i in line.split()[1:]} for line in INDEX_LINES
}

ARTICLE_LINES = [
    "1,http://x/1,One,A cat sat",
    "2,http://x/2,Cat and dog,The cat, the dog and a car",
    "3,http://x/3,Three,cat dog bird",
    "4,http://x/4,Cars,a car",
    "5,http://x/5,Cat,cat",
    "6,http://x/6,Dogs,dog",
    "no-comma-line",
    "x7,http://x/7,Bad id,cat",
    "8,http://x/8,Empty,",
]

RANGES = [("w1", 1, 3), ("w2", 5, 8)]

#: Search string -> matching documents of INDEX.
RESULTS = {
    "cat and dog": {2, 3},
    "cat or dog": {1, 2, 3, 5, 6},
    "cat and not dog": {1, 5},
    "cat not dog": {1, 5},
    "dog or cat and bird": {3},
    "dog or (cat and bird)": {2, 3, 6},
    "cat and not (dog or bird)": {1, 5},
    "CAT AND NOT bird": {1, 2, 5},
    "cat and zzzz": set(),
    "zzzz and cat": set(),
    "cat and not zzzz": {1, 2, 3, 5},
    "zzzz and not cat": set(),
    "zzzz or bird": {3},
    "zzzz or yyyy": set(),
    "a and cat": {1, 2},
    "((bird))": {3},
    "cat and cat": {1, 2, 3, 5},
}

INVALID = [
    "cat dog",
    "cat and fish dog",
    "not cat",
    "cat and",
    "cat or not dog",
    "cat and and dog",
    "(cat",
    "cat)",
    "()",
    "cat and ()",
    "cat (dog)",
    "",
    "12 ?",
]
