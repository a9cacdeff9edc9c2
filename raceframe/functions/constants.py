"""Fixed values that results must agree on: code tables, patterns, coefficients."""

# --- Fixed values: code tables -------------------------------------------------
PLACE_CODES = {
    "札幌": 0, "函館": 1, "福島": 2, "新潟": 3, "東京": 4,
    "中山": 5, "中京": 6, "京都": 7, "阪神": 8, "小倉": 9,
}
SURFACE_CODES = {
    "芝": 0, "ダ": 1, "ダート": 1, "障": 2, "障害": 2,
    "turf": 0, "dirt": 1, "steeple": 2,
}
GOING_CODES = {"良": 0, "稍": 1, "稍重": 1, "重": 2, "不": 3, "不良": 3}
GRADE_CODES = {
    "G1": 0, "G2": 1, "G3": 2, "OP": 3, "オープン": 3,
    "L": 4, "Listed": 4, "リステッド": 4,
}
SEX_CODES = {"牡": 0, "牝": 1, "セ": 2, "せん": 2}
TURN_CODES = {"右": 0, "左": 1, "直": 2, "right": 0, "left": 1, "straight": 2}
INOUT_CODES = {"内": 0, "外": 1, "直": 2, "inner": 0, "outer": 1}

# Class texts with their id, longest spelling first.
CLASS_IDS = [
    (["G3", "GIII"], 2),
    (["G2", "GII"], 1),
    (["G1", "GI"], 0),
    (["オープン", "OP", "Open"], 3),
    (["3勝", "1600万"], 4),
    (["2勝", "1000万"], 5),
    (["1勝", "500万"], 6),
    (["未勝利"], 7),
    (["新馬"], 8),
]
CLASS_ID_OTHER = 9

# Class strength, first text contained wins; grade goes first.
CLASS_RANKS = [
    ("新馬", 1), ("未勝利", 2), ("1勝", 3), ("2勝", 4), ("3勝", 5),
    ("オープン", 6), ("OP", 6), ("L", 7), ("G3", 8), ("G2", 9), ("G1", 10),
]
GRADE_RANKS = [("G1", 10), ("G2", 9), ("G3", 8)]

# Distance steps (upper bound exclusive, category).
DISTANCE_STEPS = [
    (1100, 1000), (1300, 1200), (1500, 1400), (1700, 1600), (1900, 1800),
    (2100, 2000), (2300, 2200), (2500, 2400), (2700, 2500),
]
DISTANCE_STEP_LAST = 3000
# Exact distance ranges (from, to, category) of the first variant.
DISTANCE_RANGES = [
    (1000, 1000, 1000), (1100, 1200, 1200), (1300, 1400, 1400), (1500, 1600, 1600),
    (1700, 1800, 1800), (1900, 2000, 2000), (2100, 2200, 2200), (2300, 2400, 2400),
    (2500, 2500, 2500),
]
DISTANCE_RANGE_LAST = (2600, 3000)
STEEPLE_STEPS = [(3000, 9000), (3500, 9300)]
STEEPLE_LAST = 9600
DISTANCE_NAMES = [(1400, "short"), (1800, "mile"), (2200, "middle")]
DISTANCE_NAME_LAST = "long"

INVALID_STATUS = ["中", "除", "取"]
INVALID_STATUS_TEXT = "降"
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd"]
LATE_START = "出遅れ|出遅|スタート不良"

# --- Fixed values: running styles ------------------------------------------------
STYLES = ["逃げ", "先行", "差し", "追込"]
STYLE_UNKNOWN = "不明"
STYLE_RATIOS = [(0.20, "逃げ"), (0.40, "先行"), (0.70, "差し")]
STYLE_SCORES = {"逃げ": 1.0, "先行": 0.7, "差し": 0.4, "追込": 0.1}
# (surface, distance band) -> leader rank, forward rank; the closer ratio is common.
STYLE_RANKS = {
    ("芝", "short"): (2, 5), ("芝", "medium"): (2, 5), ("芝", "long"): (2, 5),
    ("ダート", "short"): (3, 6), ("ダート", "medium"): (2, 5), ("ダート", "long"): (2, 5),
}
STYLE_RANK_DEFAULT = (2, 5)
STYLE_CLOSER_RATIO = 0.7
RECENCY_WEIGHTS = [1.0, 1.0, 1.0, 0.5, 0.5, 0.5, 0.2, 0.2, 0.2, 0.2]

# --- Fixed values: feature-name safety -------------------------------------------
UNSAFE_NAMES = [
    "h_body_weight", "h_body_weight_diff", "h_body_weight_dev", "horse_weight",
    "horse_weight_diff", "body_weight", "body_weight_diff", "avg_horse_weight",
    "market_win_odds", "market_popularity", "win_odds", "popularity", "odds",
    "finish_order", "finish_position", "time_sec", "last_3f",
    "fukusho_payout", "payout_count", "paid_places", "should_have_payout",
]
# Reasons of an exact hit, first pattern found in the name wins.
UNSAFE_NAME_REASONS = [
    ("body_weight|horse_weight", "race-day body weight information"),
    ("market|odds", "market information (odds/popularity)"),
    ("popularity", "market popularity information"),
    ("finish", "finish result information"),
    ("fukusho|payout", "payout information (post-race)"),
    ("paid_", "paid/payout information (post-race)"),
]
UNSAFE_NAME_REASON_OTHER = "pre_race unsafe feature"
UNSAFE_PATTERNS = [
    ("^market_", "market information (odds/popularity)"),
    ("^h_body_weight", "race-day body weight information"),
    ("^odds_", "odds information"),
    ("_weight_diff$", "weight difference (race-day info)"),
    ("^paid_", "payout/paid information"),
]
WARN_PATTERNS = [
    ("result", "contains 'result'"),
    ("finish", "contains 'finish'"),
    ("着順", "contains '着順' (finish order)"),
    ("払戻", "contains '払戻' (payout)"),
    ("payout", "contains 'payout'"),
    ("確定", "contains '確定' (finalized)"),
    ("after", "contains 'after'"),
    ("post", "contains 'post'"),
    ("outcome", "contains 'outcome'"),
    ("target_", "contains 'target_' (label column)"),
    ("^y_", "starts with 'y_' (possible label)"),
    ("^track_condition", "track condition (handled by scenario layer)"),
    ("^baba_", "track condition (baba, handled by scenario layer)"),
    ("_id$", "ID column (should not be feature)"),
    ("^horse_no$", "horse number (post-draw information)"),
    ("^umaban$", "horse number (post-draw information)"),
    ("^waku$", "frame number (post-draw information)"),
]
BRIDGE_PREFIX = "v4_bridge_"
BRIDGE_NOTE = "[bridged from v3]"

# --- Fixed values: availability levels, in order of time ---------------------------
LEVELS = ["pre_race", "morning", "paddock", "just_before", "result"]
LEVEL_BY_NAME = {
    "race_id": "pre_race", "horse_id": "pre_race", "race_date": "pre_race",
    "finish_position": "result", "finish_time": "result", "着順": "result", "着差": "result",
}
LEVEL_PATTERNS = [
    ("result", "^(finish_position|finish_time|final_3f)$|着順|着差|着時間|上がり.*3f|上がり.*タイム"
               "|通過順|コーナー.*通過|passing.*order|prize.*money|払戻|payout|人気結果|final.*popularity"),
    ("just_before", "^(odds|odds_win|odds_place|odds_show|popularity|人気|人気順位)$|最終.*オッズ|直前.*オッズ"),
    ("paddock", "^(weight|horse_weight|weight_change)$|馬体重$|体重増減|体重変化"),
    ("morning", "moisture|cushion|^track_condition$|馬場状態|weather$|天候|天気|baba.*index|馬場指数"),
]

# --- Fixed values: feature groups by prefix, first hit wins -------------------------
FEATURE_GROUPS = [
    ("base_race", ["place_id", "surface_id", "distance", "track_condition_id",
                   "course_turn_id", "course_inout_id", "race_year", "race_month",
                   "race_day_of_week", "race_no", "grade_id", "race_class_id",
                   "field_size", "waku", "umaban", "sex_id", "age", "weight"]),
    ("horse_form", ["h_"]),
    ("pace_position", ["pace_", "pos_"]),
    ("class_prize", ["class_", "prize_"]),
    ("jockey_trainer", ["j_", "t_"]),
    ("pedigree", ["ped_hash_", "anc_hash_"]),
    ("market", ["market_"]),
]

# --- Fixed values: scenario coefficients, first set ---------------------------------
STYLE_ALIASES = {
    "逃げ": "逃げ", "先行": "先行", "差し": "差し", "追込": "追込",
    "NIGE": "逃げ", "SENKO": "先行", "SENKOU": "先行", "好位": "先行",
    "SASHI": "差し", "SASI": "差し", "OIKOMI": "追込", "追い込み": "追込", "自在": "先行",
}
STYLE_CATEGORY = {"逃げ": "front_runner", "先行": "pace_keeper", "差し": "mid_chaser", "追込": "deep_closer"}
# (pace, category) -> win factor, in3 factor; other pairs are 1.
PACE_FACTORS = {
    ("S", "front_runner"): (1.20, 1.10), ("S", "pace_keeper"): (1.10, 1.05),
    ("S", "mid_chaser"): (0.95, 0.98), ("S", "deep_closer"): (0.85, 0.92),
    ("H", "front_runner"): (0.80, 0.90), ("H", "pace_keeper"): (0.90, 0.95),
    ("H", "mid_chaser"): (1.10, 1.05), ("H", "deep_closer"): (1.20, 1.12),
}
LEADER_FACTORS = {"S": (1.05, 1.03), "M": (1.03, 1.02), "H": (0.95, 0.97)}
WEAK_FACTORS = (0.85, 0.90)
BIAS_GAIN = (1.05, 1.03)
BIAS_LOSS = (0.97, 0.98)

# --- Fixed values: scenario coefficients, second set --------------------------------
PACE_STYLE = {
    ("S", "逃げ"): (1.20, 1.12), ("S", "先行"): (1.12, 1.08),
    ("S", "差し"): (0.92, 0.95), ("S", "追込"): (0.82, 0.88),
    ("H", "逃げ"): (0.80, 0.88), ("H", "先行"): (0.90, 0.94),
    ("H", "差し"): (1.12, 1.08), ("H", "追込"): (1.22, 1.14),
}
GOING_FACTOR = {"良": 1.00, "稍重": 0.99, "重": 0.97, "不良": 0.94}
LANE_BIAS = {
    ("inner", "inner_lane"): (1.06, 1.04), ("inner", "outer_lane"): (0.96, 0.97),
    ("middle", "middle_lane"): (1.03, 1.02),
    ("outer", "inner_lane"): (0.96, 0.97), ("outer", "outer_lane"): (1.06, 1.04),
}
STYLE_BIAS = {
    ("front", "逃げ"): (1.10, 1.06), ("front", "先行"): (1.06, 1.04),
    ("front", "差し"): (0.95, 0.97), ("front", "追込"): (0.90, 0.94),
    ("closer", "逃げ"): (0.90, 0.94), ("closer", "先行"): (0.95, 0.97),
    ("closer", "差し"): (1.06, 1.04), ("closer", "追込"): (1.10, 1.06),
}

# --- Fixed values: pace shift in log-odds --------------------------------------------
PACE_SHIFT = {"逃げ": -1.0, "先行": -0.5, "差し": 0.7, "追込": 1.0}
PACE_SHIFT_ALPHA, PACE_SHIFT_SCALE, PACE_SHIFT_MAX = 0.7, 3.0, 1.5

# --- Fixed values: thresholds and defaults -------------------------------------------
PROB_THRESHOLDS = [0.06, 0.07, 0.08, 0.09, 0.10, 0.12, 0.15, 0.18, 0.20]
GAP_THRESHOLDS = [0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.08]
PLACE_PROB_GRID = [0.25, 0.30, 0.35, 0.40]
PLACE_GAP_GRID = [0.02, 0.04, 0.06, 0.08, 0.10]
ODDS_DEFAULT = 999.0
RELATIVE_COLUMNS = [
    "hr_career_in3_rate", "hr_career_win_rate", "hr_career_avg_finish", "hr_career_avg_last3f",
    "hr_recent5_avg_finish", "hr_recent5_best_finish", "hr_recent5_avg_last3f",
    "hr_recent5_big_loss_count", "hr_recent3_avg_win_odds", "hr_recent3_finish_trend",
    "hr_days_since_prev",
]
SMALLER_IS_BETTER = {
    "hr_career_avg_finish", "hr_career_avg_last3f", "hr_recent5_avg_finish",
    "hr_recent5_best_finish", "hr_recent5_avg_last3f", "hr_recent5_big_loss_count",
    "hr_recent3_avg_win_odds", "hr_days_since_prev",
}

# --- Fixed values: memo negation and intensity ---------------------------------------
NEGATION_AFTER = [
    "ではない", "じゃない", "でない", "なさそう", "ないだろう", "ないかも",
    "にくい", "しにくい", "づらい", "しづらい", "難しい", "厳しい",
    "ほどでは", "とは言え", "とは思え", "とは考え",
]
NEGATION_BEFORE = ["ない", "無い"]
DOUBT_AFTER = ["疑問", "微妙", "怪しい", "不透明"]
INTENSITY = {
    1.5: ["超", "極めて", "相当", "圧倒的に", "圧倒的", "極端に", "極端な", "かなりの",
          "相当な", "間違いなく", "確実に", "完全に", "完全な"],
    1.3: ["かなり", "非常に", "とても", "明らかに", "明らかな", "明確に", "明確な",
          "顕著に", "顕著な", "はっきり", "断然", "絶対", "当然"],
    0.7: ["やや", "少し", "ちょっと", "多少", "若干", "微妙に", "なんとなく",
          "どちらかと言えば", "傾向として", "たぶん", "おそらく", "可能性"],
    0.5: ["ほぼ", "ほとんど", "気持ち", "わずかに", "僅かに", "ごくわずか", "微か"],
}

# --- Fixed values: failure categories by text in the message, first hit wins ---------
FAILURE_TEXTS = [
    ("timeout", ["timeout", "timed out", "read timed out"]),
    ("http_4xx", ["400", "401", "403", "429"]),
    ("http_5xx", ["500", "502", "503", "504"]),
    ("parse", ["parse", "attribute", "keyerror", "indexerror"]),
    ("network", ["connection", "refused", "reset", "broken pipe"]),
]
