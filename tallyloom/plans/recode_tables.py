"""Code tables of the recodes. Fixed values throughout."""

# country names in open answers -> ISO numeric code
COUNTRIES = {
    "中國": 156, "俄羅斯": 643, "加拿大": 124, "北韓": 408, "南非": 710, "印尼": 360, "台灣": 158,
    "墨西哥": 484, "奧地利": 40, "孟加拉": 50, "德國": 276, "挪威": 578, "新加坡": 702, "日本": 392,
    "比利時": 56, "法國": 250, "泰國": 764, "澳大利亞": 36, "澳洲": 36, "緬甸": 104, "香港": 158,
    "澳門": 158, "瑞典": 752, "瑞士": 756, "美國": 840, "英國": 826, "荷蘭": 528, "西班牙": 724,
    "越南": 704, "阿富汗": 4, "阿根廷": 32, "韓國": 410, "南韓": 410, "馬來西亞": 458,
}

# (lowest postcode, highest postcode, region)
REGIONS = [
    (200, 206, 1), (100, 116, 2), (220, 253, 3), (320, 338, 4), (3001, 3003, 5), (300, 300, 5),
    (302, 315, 6), (350, 369, 7), (400, 439, 8), (540, 558, 10), (500, 530, 11), (630, 655, 12),
    (6001, 6002, 13), (600, 600, 13), (602, 625, 14), (700, 745, 15), (800, 852, 17),
    (900, 947, 19), (260, 290, 20), (970, 983, 21), (950, 966, 22), (880, 885, 23),
]

ONLY, YOUNGEST, OLDEST = "唯一合格者", "最年輕者", "最年長者"
SECOND, THIRD, FOURTH, FIFTH = "第二年輕者", "第三年輕者", "第四年輕者", "第五年輕者"
UNDEFINED = "未定義"

# selection rule -> (tests of the household size in order, who is asked if none holds);
# a household of one has only ONLY
SELECTION = {
    1: ([], YOUNGEST),
    2: ([("<", 5, YOUNGEST)], SECOND),
    3: ([("<", 5, YOUNGEST)], THIRD),
    4: ([("=", 2, YOUNGEST), ("<", 5, SECOND)], THIRD),
    5: ([("=", 2, YOUNGEST), ("<", 5, SECOND)], FOURTH),
    6: ([("=", 2, OLDEST), ("=", 3, SECOND), ("=", 4, THIRD)], FOURTH),
    7: ([("=", 2, OLDEST), ("=", 3, SECOND), ("=", 4, THIRD), ("=", 5, FOURTH)], FIFTH),
    8: ([], OLDEST),
}

# household size -> who was asked -> weight in 48ths
DESIGN_WEIGHTS = {
    1: {ONLY: 8},
    2: {YOUNGEST: 5, OLDEST: 3},
    3: {YOUNGEST: 3, SECOND: 3, OLDEST: 2},
    4: {YOUNGEST: 3, SECOND: 2, THIRD: 2, OLDEST: 1},
    5: {YOUNGEST: 1, SECOND: 1, THIRD: 2, FOURTH: 3, OLDEST: 1},
    6: {YOUNGEST: 1, SECOND: 1, THIRD: 2, FOURTH: 2, FIFTH: 1, OLDEST: 1},
}

# level -> result, whatever the completion
EDUCATION_SIMPLE = {10: [1], 20: [2], 550: [11, 12, 13, 14, 15], 600: [16], 650: [17, 18],
                    740: [20], 840: [21], -9: [-8]}

# (levels, years of a complete course, unfinished status codes, unfinished, finished)
EDUCATION_STAGED = [
    ([3], 6, [2], 30, 100),
    ([4], 9, [2, 3], 242, 243),
    ([5], 9, [2], 252, 253),
    ([6], 12, [2, 3], 342, 343),
    ([7, 8, 9], 12, [2, 3], 352, 353),
    ([10], 14, [2, 3], 450, 453),
    ([19], 16, [2, 3], 343, 640),
]

# result -> answers, by recode
MAINSTAT = {1: [1, 2, 3, 4, 5, 8, 14, 15], 2: [6], 3: [7], 4: [9], 5: [12], 6: [10], 7: [11], 8: [13], 9: [16],
            -9: [-6, -7, -8]}
RELIGION_GROUP_ONE_ITEM = {0: [8], 1: [6], 2: [7], 6: [5], 7: [1], 9: [2, 3, 4]}
RELIGION_GROUP = {0: [9], 1: [7], 2: [8], 6: [6], 7: [1, 2], 9: [3, 4, 5], 10: [10]}
ETHNIC_GROUP = {1: [1], 2: [2], 3: [3, 8], 4: [4], 5: [5, 6], 6: [7], 7: [9, 10], -7: [-8], -8: [-7]}

# answer -> amount of the open and wide income classes; the others are bands of 10000
PERSONAL_INCOME = {22: 250000, 23: 300000}
HOUSEHOLD_INCOME = {22: 250000, 23: 350000, 24: 450000, 25: 750000, 26: 1000000}

# (device, visuals, helper) answers -> mode of the interview; the first line that fits counts
PAPER, COMPUTER = (2, 3), (1,)
NO_VISUALS, VISUALS, READ_OUT = (2,), (1, 3), (4,)
ALONE, HELPED = (0,), (1,)
INTERVIEW_MODES = [
    (PAPER, NO_VISUALS, ALONE, 10), (PAPER, VISUALS, ALONE, 11), (PAPER, READ_OUT, ALONE, 12),
    (PAPER, NO_VISUALS, HELPED, 13), (PAPER, VISUALS, HELPED, 14),
    (COMPUTER, VISUALS, ALONE, 21), (COMPUTER, READ_OUT, ALONE, 22),
    (COMPUTER, NO_VISUALS, HELPED, 23), (COMPUTER, VISUALS, HELPED, 24),
]
OTHER_MODE = 20
NO_INTERVIEWER_DEVICE = 4
