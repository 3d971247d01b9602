"""Word lists, cut-offs and column names of the survey this library can analyse.

Everything here has to equal the survey's own definitions for results to be right,
so it is plain data, in its natural order. The operators take all of it as
parameters; none of it is built into them.
"""

# --- fixed values: cleaning and audit ----------------------------------------

MISSING_TOKENS = ("ND", "UK", "NA", "N/A", "N\\A", "N-D", "N.D", "UNK", "UNKNOWN")

DATE_WORD = "日期"

NUMERIC_KEYWORDS = (
    "年龄", "BMI", "体重", "身高", "围", "血压", "血糖", "胆固醇", "甘油", "糖化",
    "次数", "数量", "年数", "得分", "总分", "时间", "速度", "评分", "剂量", "kg", "cm", "mm",
)

MISSING_BINS = (
    ("<=5%", 0.05), ("5-20%", 0.2), ("20-50%", 0.5), ("50-80%", 0.8), ("80-95%", 0.95), ("95-100%", 1.0),
)

NON_FEATURES = (
    "序号", "编号", "患者编码", "详细地址", "备注",
    "基本信息", "慢病收集", "辅助检查", "认知", "心理", "感知", "活力", "运动",
)

# --- fixed values: binary domain rules (domain, column, comparison, cut-off) ---

DOMAIN_RULES = (
    ("sensory", "听力障碍", "==", 1),
    ("sensory", "视力障碍", "==", 1),
    ("sensory", "感知-听力", "==", 0),
    ("sensory", "感知-视力", "==", 0),
    ("sensory", "听力障碍是否影响日常", "==", 1),
    ("sensory", "视力障碍是否影响日常", "==", 1),
    ("vitality", "活力-营养描述结果", "<=", 1),
    ("vitality", "活力-过去三个月内有没有因为食欲不振、消化问题、咀嚼或吞咽困难而摄食减少", "<=", 1),
    ("vitality", "活力-过去三个月内体重下降情况", "<=", 1),
    ("vitality", "活力-BMI值", "<", 18.5),
    ("vitality", "小腿围", "<", 33),
    ("locomotion", "步态异常-编码", "==", 1),
    ("locomotion", "衰弱快速筛查量表-1您能步行250米么？", "==", 1),
    ("locomotion", "肌少症评估-2步行穿过房间是否存在困难，是否需要帮助？", ">=", 1),
    ("locomotion", "运动-总分", "<=", 9),
    ("cognition", "认知-总分", "<", 24),
    ("psychological", "心理-总分", ">=", 5),
    ("psychological", "是否焦虑抑郁症", "==", 1),
)

GRIP_COLUMNS = ("Fried衰弱表型评估-握力左手最大值", "Fried衰弱表型评估-握力右手最大值")
GRIP_CUTOFFS = {1: 28, 0: 18}  # by sex
SEX = "性别"

DOMAINS = ("sensory", "vitality", "locomotion", "cognition", "psychological")

# --- fixed values: leakage lists ------------------------------------------------

LEAKAGE_FIELDS = (
    "听力障碍", "视力障碍", "听力障碍是否影响日常", "视力障碍是否影响日常",
    "感知-听力", "感知-视力",
    "活力-营养描述结果", "活力-过去三个月内有没有因为食欲不振、消化问题、咀嚼或吞咽困难而摄食减少",
    "活力-过去三个月内体重下降情况", "活力-BMI值", "小腿围",
    "步态异常-编码", "衰弱快速筛查量表-1您能步行250米么？",
    "肌少症评估-2步行穿过房间是否存在困难，是否需要帮助？", "运动-总分",
    "Fried衰弱表型评估-握力左手最大值", "Fried衰弱表型评估-握力右手最大值",
    "认知-总分", "心理-总分", "是否焦虑抑郁症",
    "活力-总分", "Fried衰弱表型评估-总分", "肌少症评估-总分", "衰弱快速筛查量表-总分",
)

FUNCTIONAL_PATTERNS = (
    "ADL", "IADL", "运动", "步态", "步行", "握力", "衰弱", "跌倒", "Fried", "肌少", "生活质量",
    "认知", "心理", "感知", "活力", "营养", "小腿围", "BMI", "视力", "听力", "SPPB",
)

# --- fixed values: report names ---------------------------------------------------

EXTERNAL_ALIAS = {
    "ADL量表-总分": "ADL total",
    "IADL量表-总分": "IADL total",
    "肌少症评估-总分": "Sarcopenia score",
    "Fried衰弱表型评估-总分": "Fried frailty score",
    "衰弱快速筛查量表-总分": "Frailty screen score",
    "跌倒评估-总分": "Fall risk score",
    "弹性评估-总分": "Resilience score",
    "生活行为与社会功能评估-总分": "Social function score",
    "生命质量评估-1）总体来讲，您的健康状况是": "QoL general health",
    "生命质量评估-10）在过去4个星期里，您有多少时间感到精力充沛？": "QoL energy",
    "生命质量评估-11）在过去4个星期里，您有多少时间感到心情不好、闷闷不乐或沮丧？": "QoL depressed mood",
    "生命质量评估-12）在过去4个星期里，有多少时间由于您身体健康或情绪问题而妨碍您的社交活动（比如探亲、访友等）？": "QoL social limitation",
}

SUMMARY_ALIAS = {
    "年龄": "Age",
    "患有慢性病数量": "Chronic disease count",
    "服用药物数量": "Medication count",
    "过去一年住院次数": "Hospitalizations (1y)",
    "过去一年急诊次数": "ED visits (1y)",
    "查尔森合并症得分": "Charlson score",
    "健康自评分数": "Self-rated health score",
    "认知-总分": "Cognition raw score",
    "心理-总分": "Psychological raw score",
    "活力-总分": "Vitality raw score",
    "运动-总分": "Locomotion raw score",
}

SCORE_ALIAS = {
    "cognition_100": "Cognition",
    "psychological_100": "Psychological",
    "vitality_100": "Vitality",
    "locomotion_100": "Locomotion",
    "sensory_100": "Sensory",
    "total_100": "Overall IC",
}

# --- fixed values: clipped counts and text cards ---------------------------------------

WINSORIZED = ("患有慢性病数量", "服用药物数量", "过去一年住院次数", "过去一年急诊次数", "查尔森合并症得分")

CARD_SECTIONS = {
    "Demographics": ("年龄", "性别", "婚姻状况", "家庭类型", "文化程度", "经济状况", "健康状态", "健康自评分数"),
    "Burden": ("患有慢性病数量", "服用药物数量", "过去一年住院次数", "过去一年急诊次数", "查尔森合并症得分"),
    "Key diseases": ("是否高血压", "是否糖尿病", "是否骨关节病", "是否骨质疏松", "是否脑血栓", "是否焦虑抑郁症",
                     "是否白内障", "是否青光眼"),
    "Sensory": ("听力障碍", "听力障碍是否影响日常", "视力障碍", "视力障碍是否影响日常", "感知-视力", "感知-听力",
                "自我感觉嗅觉"),
    "Cognition": ("认知-总分",),
    "Psychological": ("心理-总分",),
    "Vitality": ("活力-总分", "活力-营养描述结果", "活力-BMI值", "小腿围"),
    "Locomotion": ("运动-总分", "运动是否完成编码", "步态异常-编码",
                   "运动-4米行走时间：日常行走速度走完4米-平均完成时间",
                   "Fried衰弱表型评估-握力左手最大值", "Fried衰弱表型评估-握力右手最大值"),
}
