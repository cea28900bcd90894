"""The whole preparation of a raw subscriber table, as one lazy plan per result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators import clean, sampling

# English attribute names of the raw subscriber tables and the names used after renaming.
SUBSCRIBER_NAMES = {
    "IS_VIP_USER": "重要客户标识", "VIP_CODE": "会员级别", "AGE": "年龄", "SEX": "性别",
    "profession_code": "职业编码", "education_code": "教育程度编码", "marital_status": "婚姻状况",
    "cust_star_lvl": "客户星级", "brand_id": "品牌标识", "is_m2m_yx": "是否物联网标识（亚信口径）",
    "is_m2m_td": "是否物联网标识（TD口径）", "user_star_lvl": "用户星级分值", "is_village_user": "是否农村用户",
    "is_school_user": "是否校园用户", "is_group": "是否集团用户", "raise_card_id": "疑似养卡标识",
    "user_status": "用户状态", "innet_months": "在网时长（月数）", "stop_days": "停机时长(天)",
    "mon_halt_cnt": "月停机次数", "year_total_halt_cnt": "年累计停机次数",
    "msisdn_m6_halt_rate": "手机号码近6个月总停机频次", "msisdn_owe_halt_rate": "手机号码欠费停机频次",
    "user_m6_owe_halt_cnt": "用户近6个月欠费停机次数", "mon_break_id": "月流失标识", "package_sms": "套内短信条数",
    "package_voice": "套内语音分钟数", "package_flux": "套内流量数", "term_brand": "终端品牌",
    "this_acct_fee_tax": "当月消费总金额", "this_flux_days": "月上网天数", "gprs_total_flux": "月总使用流量",
    "flux_sj_roam_days": "当月省内漫游流量天数", "flux_gj_roam_days": "当月省际漫游流量天数", "sms_cnt": "短信条数",
    "sms_user_cnt": "短信人数", "sms_circle_user_cnt": "短信交往圈联系人数",
    "OUT_IN_SMS_CIRCLE_USER_CNT": "短信交往圈双向重合人数", "AVG_SMS_CNT": "交往圈人均短信条数",
    "avg_ptp_sms_cnt": "交往圈人均点对点短信条数", "out_sms_days": "短信发送天数", "ptp_sms_days": "点对点短信发送天数",
    "sms_rate": "短信频度", "BEL_SAME_OPPO_CNT": "当月呼出出对端和本机归属地相同的不重复对端数",
    "RESID_SAME_OPPO_CNT": "当月呼出出对端和本机常驻地相同的不重复对端数",
    "MAX_DAY_IN_VOICE_CNT": "当月内用户日最高被叫通话次数", "MAX_DAY_OUT_VOICE_CNT": "当月内用户日最高主叫通话次数",
    "MAX_DAY_IN_VOICE_DURA": "当月内用户日最高被叫通话时长", "MAX_DAY_OUT_VOICE_DURA": "当月内用户日最高主叫通话时长",
    "PTP_SMS_CNT": "当月点对点短信下行量", "MAX_DAY_PTP_SMS_CNT": "当月内日最高点对点短信下行量",
    "RESID_CITY_DAY_STAY_DAYS": "当月白天常驻城市停留天数", "RESID_CITY_NIGHT_STAY_DAYS": "当月夜间常驻城市停留天数",
    "RESID_DAY_CITY_CNT": "当月白天常驻过城市数里（剔重）", "RESID_NIGHT_CITY_CNT": "当月夜间常驻过城市数里（剔重）",
    "OPPO_BEL_CITY_CNT": "当月与该号码通话的对端所属城市数量", "OPPO_MAX_CITY_NAME": "当月与该号码通话次数最多的城市名称",
    "COMM_BASESTA_CNT": "当月通信基站个数", "ACT_CELL_JF_DURA": "主要活动小区呼出计费时长",
    "ACT_CELL_VOICE_CNT": "主要活动小区呼出通话次数", "ACT_CELL_FLUX": "主要活动小区使用流量",
    "FRE_TERM_MSISDN_CNT": "当月用户最常用终端附着号码量", "TERM_MSISDN_CNT": "当月用户终端附着号码量",
    "VOICE_DURA": "通话时长", "OUT_VOICE_DURA": "主叫通话时长", "IN_VOICE_DURA": "被叫通话时长",
    "VOICE_CNT": "通话次数", "OUT_VOICE_CNT": "主叫通话次数", "IN_VOICE_CNT": "被叫通话次数",
    "TRANS_OUT_VOICE_CNT": "呼转通话次数", "VOICE_CIRCLE_USER_CNT": "语音交际圈人数", "OUT_USER_CNT": "主叫人数",
    "IN_USER_CNT": "被叫人数", "PRESENT_PKG_USED_VOICE": "套餐外语音使用量", "VOICE_DAYS": "通话天数",
    "VOICE_BASESTA_CNT": "语音月基站个数",
}
# Columns dropped after renaming, and columns kept as text.
SUBSCRIBER_DROP = ["msisdn", "年累计停机次数", "会员级别", "是否物联网标识（亚信口径）", "是否物联网标识（TD口径）",
                   "终端品牌", "当月与该号码通话次数最多的城市名称", "品牌标识"]
SUBSCRIBER_TEXT = ["重要客户标识", "性别", "职业编码", "教育程度编码", "婚姻状况", "客户星级", "品牌标识", "是否农村用户",
                   "是否校园用户", "是否集团用户", "疑似养卡标识", "用户状态", "月流失标识", "短信频度"]


@dataclass
class CleanTable:
    rows: DataFrame
    dropped_missing: list[str]
    dropped_zero: list[str]


def clean_subscribers(tables: Sequence[DataFrame], key: str, label: str = "label",
                      names: Mapping[str, str] = SUBSCRIBER_NAMES, text: Sequence[str] = SUBSCRIBER_TEXT,
                      drop: Sequence[str] = SUBSCRIBER_DROP, max_missing: float = 0.2,
                      max_zero: float = 0.3) -> CleanTable:
    """Union, rename, clear tokens, type, prune columns and keep complete rows.

    The key is only carried along to make sampling repeatable. Both prunings come from one
    pass over the table. The label is never pruned.
    """
    df = clean.rename_columns(clean.concat_tables(*tables), names)
    df = clean.drop_columns(df, [c for c in drop if c != key])
    df = clean.cast_columns(clean.null_tokens(df), text, label, keep=[key])
    df = clean.null_tokens(df)  # text 'NaN' casts to a number that means "missing"
    rates = clean.column_rates(df, [key, label]).collect()  # one row per column
    sparse = {r["feature"] for r in rates if r["missing_rate"] > max_missing}
    zero = {r["feature"] for r in rates if r["zero_rate"] > max_zero and r["feature"] not in sparse}
    kept = clean.complete_cases(df.drop(*sparse, *zero))
    return CleanTable(kept, [c for c in df.columns if c in sparse], [c for c in df.columns if c in zero])


def ratio_samples(df: DataFrame, key: str, label: str = "label", ratios: Sequence[int] = (1, 2, 3, 4, 5),
                  seed: int = 42) -> dict[str, DataFrame]:
    """'data_all' and one 'data_ratio_1_k' per ratio."""
    return {"data_all": df, **{f"data_ratio_1_{k}": sampling.ratio_sample(df, [key], label, k, seed) for k in ratios}}


def samples(df: DataFrame, key: str, label: str = "label", ratios: Sequence[int] = (1, 2, 3, 4, 5), seed: int = 42) -> DataFrame:
    """The same tables as one, told apart by ``sample``: one counting pass and one scan for all ratios."""
    part = sampling.ratio_samples(df, [key], label, ratios, seed, out="_k")
    name = F.concat(F.lit("data_ratio_1_"), F.col("_k"))
    return df.withColumn("sample", F.lit("data_all")).unionByName(part.withColumn("sample", name).drop("_k"))
