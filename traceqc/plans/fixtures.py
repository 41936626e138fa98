"""Tables of the domain, derived from the given tables by SQL that both engines run.

``{name}`` stands for a table. Spark fills it with a DataFrame, the oracle with the table's name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"
K = "c_custkey"

_FOOTER = "concat(cast({i}*8 as string), '秒 10:00:0{i} ', case when c_custkey%3=0 then '闪光刺激' else '背景' end, ' ', case when c_custkey%5=0 then '50uV/3.5mm' else '50uV/5mm' end, ' 3厘米/秒 编号：', cast(c_custkey as string))"


def _wave(i: int) -> str:
    names = f"case when c_custkey%2=0 then concat('O1-A1', {NL}, ' O2-A2 ', {NL}, 'FP1-A1') else concat('FP1-F3', {NL}, 'F3-C3') end"
    return f"""case when c_custkey%4 < {i} then '' when c_custkey%17 = {i} then concat(chr(12), '姓名 脑电图', {NL}, 'O1-A1')
      when c_custkey%19 = {i} then concat(chr(12), 'no waveform here')
      when c_custkey%23 = {i} then concat(chr(12), '编号：', {NL}, chr(12), {NL}, chr(12), ' ', cast(c_custkey as string), ' x')
      else concat(chr(12), {names}, {NL}, case when c_custkey%3<>1 then concat('标记', {NL}) else '' end, {_FOOTER.replace("{i}", str(i))}, {NL}) end"""


#: Document texts: a report page (none for every tenth), up to three further pages, form feeds between them.
DOCUMENTS = f"""
select concat('f', lpad(cast({K} as string), 9, '0'), '.pdf') source_file, concat(
  case when {K}%10=0 then concat('O1-REF', {NL}, '8秒 10:00:00 背景 50uV/5mm 3厘米/秒 编号： ', cast({K} as string)) else concat(
    '  脑电图报告', {NL}, '姓名：', c_name, '  年龄：', cast(20+{K}%60 as string), '  性别：', case when c_nationkey%2=0 then '男' else '女' end,
    '  编号：', case when {K}%13=0 then '' else cast({K} as string) end, {NL}, '左右利： 右  合作：', case when {K}%6=0 then '' else '是' end, {NL},
    '检查日期：2024-01-', lpad(cast(1+{K}%28 as string), 2, '0'), {NL}, '意识：清醒', {NL}, '药物：', case when {K}%3=0 then 'VPA' else '' end, {NL},
    '临床诊断：', c_mktsegment, '  癫痫 type 2', {NL}, '检查者： 医生', cast({K}%7 as string), {NL},
    case when {K}%9=0 then '' else concat('起点 ', cast({K}%50 as string), '秒 10:00:05 处理长度 ', cast(8*(1+{K}%3) as string), '秒', {NL}) end,
    case when {K}%8=0 then '' else concat('床号：', cast(c_nationkey as string), {NL}) end, '脑电图：', {NL},
    '  基本 节律 alpha  ', c_mktsegment, ' ，', {NL}, '  两侧 对称。 C3-A1', {NL}, '----- rule', {NL}, '诱发： 无 ', {NL}, ' 变化',
    case when {K}%2=0 then concat({NL}, '脑电地形图：', {NL}, ' 未见 异常。', {NL}) else '' end,
    {NL}, '结论： ', c_mktsegment, '  正常', {NL}, '复查；', {NL}, '随访 6 months  仅供参考', {NL}, '处理长度') end,
  {_wave(1)}, {_wave(2)}, {_wave(3)}, case when {K}%2=0 then chr(12) else '' end) text
from {{customer}}"""

#: A report for each customer; one in 71 shares the record id of the one before.
REPORTS = f"""
select concat('f', lpad(cast({K} as string), 9, '0')) source_file, cast(case when {K}%71=0 then {K}-1 else {K} end as string) record_id,
  case when {K}%97=0 then null else concat('N', cast({K} as string)) end name,
  case when c_nationkey%2=0 then 'M' else 'F' end sex, case when {K}%89=0 then 'x' else cast(20+{K}%5 as string) end age
from {{customer}}"""

#: A subject for each order, ten for each customer. Three of these have the customer's name (of which two the same key
#: for one name in six), the others names of their own.
SUBJECTS = """
select concat('S', cast(o_orderkey as string)) subject_id, case when i < 3 then concat(' N', cast(k as string)) when o_orderkey%997 = 0 then null else concat(' U', cast(o_orderkey as string)) end name,
  case when i%2=0 then 'M' else 'F' end sex, cast(20 + (k*4 + case when i=2 and k%6=0 then 0 else i*5 end)%9 as string) age
from (select o_orderkey, cast(floor(o_orderkey/10) as bigint) k, o_orderkey%10 i from {orders}) o"""

#: A manual row for each customer, of which one in fifty names a record; one in a hundred has no subject.
MANUAL = f"""
select case when {K}%50=0 then cast({K} as string) else concat('other', cast({K} as string)) end record_id,
  case when {K}%100=0 then null else concat('M', cast({K} as string)) end subject_id
from {{customer}}"""

#: An exam for each line item; those of one order in twenty have no subject.
EXAMS = """
select case when l_orderkey%20=0 then null else cast(l_orderkey as string) end subject_id, concat('r', cast(l_orderkey as string)) record_id, l_shipdate ship,
  concat(cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(l_shipdate as string), '-', cast(l_quantity as string)) source_file,
  case when l_partkey%11=0 then null when l_partkey%7=0 then '2024-13-40' else substr(cast(l_shipdate as string), 1, 10) end exam_date
from {lineitem}"""

VISITS = """
select cast(o_orderkey as string) subject_id, o_orderdate + o_orderkey%24 * interval '1' hour test_time,
  case when o_orderkey%9=0 then null when o_orderkey%10=0 then 'n/a' else substr(cast(o_orderdate as string), 1, 10) end eeg_time
from {orders}"""

#: Waveform pages of records (flat), in order, with numbers that stand for measured ones.
WAVES = """
select cast(l_orderkey as string) rec, wave_idx, wave_idx + 1 page_no, l_partkey part, l_suppkey supp, l_quantity qty, l_orderkey ord,
  case l_returnflag when 'A' then '背景' when 'N' then '闪光刺激' else '' end stage,
  case when l_partkey%13=0 then '' when l_linestatus='F' then '50uV/5mm' else '50uV/3.5mm' end sensitivity,
  case when l_partkey%29=0 then '' else '3厘米/秒' end speed,
  cast(cast(floor(l_quantity) as int) - 1 as string) time_in_record,
  case when l_partkey%31=0 then '' when l_linenumber%3=0 then 'O1-A1,O2-A2,FP1-A1,FP2-A2' when l_linenumber%3=1 then 'O1-REF,O2-REF,O1-REF' else 'FP1-F3,F3-C3' end channels,
  l_suppkey%5>0 marker_row
from (select *, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) as int) wave_idx from {lineitem}) x"""

#: Page QC rows.
PAGES = f"""
select rec, page_no, wave_idx, stage, sensitivity, speed, time_in_record, channels, part, supp, ord,
  case when channels like '%A1%' then 'A1/A2参考' when channels like '%REF%' then 'REF' else '双极' end montage,
  sensitivity = '' sens_missing, cast(800 + part%3 as int) n_points, cast(100.0 + part%3/cast(8.0 as double) as double) fs_len, cast(99.0 + supp%2/cast(3.0 as double) as double) fs_paper,
  cast(0.85 + supp%4/cast(1000.0 as double) as double) x_step_pt, cast(0.12 + part%5/cast(100.0 as double) as double) y_min_step_pt,
  cast(case when sensitivity = '50uV/3.5mm' then 5.04 when part%17 = 0 then 3.54 else 3.53 end as double) uV_per_pt, cast((0.12 + part%5/cast(100.0 as double))*3.5 as double) y_res_uV,
  cast(20.0 + supp%7/cast(50.0 as double) as double) row_spacing_pt, cast(part%7 as int) marker_transitions, part%7 = 3 marker_regular,
  case when part%7=3 then '48 98 148' when part%7=0 then '' else concat('48 ', cast(50 + part%40 as string)) end marker_positions
from ({WAVES}) w"""

#: Channel QC rows: four channels a page.
CHANNELS = f"""
select rec, page_no, ch, std_uV, ptp_pt, ptp_pt*3.5 ptp_uV, flat_frac, clip_frac, ptp_pt > 95 overrange, off_center_pt, zcr_hz, hf_40_49, p_hf_ratio, p_lo_ratio, cast(n_levels as int) n_levels,
  rel_alpha, abs_alpha, abs_delta, alpha_seg_cv, start_rms_ratio, start_slope_ratio, h1_alpha, h1_alpha*0.8 + h2x h2_alpha, h2x h1_beta, h2x*h2x h2_beta, rel_alpha*0.5 h1_delta, std_uV/cast(30.0 as double) h2_delta, zcr_hz/cast(60.0 as double) h1_theta, zcr_hz/cast(60.0 as double) + h2x/cast(9.0 as double) h2_theta
from (select rec, page_no, case i when 0 then 'O1-A1' when 1 then 'O2-A2' when 2 then 'FP1-A1' else 'FP2-A2' end ch,
  cast(case when (part*7+i)%211=0 then 900.0 when (part+i)%97=0 then 0.5 else 10.0 + (part*(i+3)+supp)%200/cast(10.0 as double) end as double) std_uV,
  cast((part*(i+1)+supp*3)%1000/cast(10.0 as double) as double) ptp_pt, cast((supp*(i+5)+part)%113/cast(200.0 as double) as double) flat_frac, cast(case when (part*5+i)%53=0 then 0.02 else 0.0 end as double) clip_frac,
  cast((part+i*17)%41/cast(10.0 as double) - 2 as double) off_center_pt, cast(5.0 + (part*3+i*11+supp)%307/cast(20.0 as double) as double) zcr_hz, cast(0.0001 + (part*11+i)%503/cast(9000.0 as double) as double) hf_40_49,
  cast(case when (part*13+i)%307=0 then null else 0.01 + (part*17+i*3+supp)%401/cast(1000.0 as double) end as double) p_hf_ratio, cast(0.05 + (supp*19+i*7+part)%197/cast(400.0 as double) as double) p_lo_ratio,
  40 + (part+supp*i)%60 n_levels, cast((part*23+i*5)%331/cast(400.0 as double) as double) rel_alpha, cast((part*29+supp*i)%977/cast(9.0 as double) as double) abs_alpha, cast((supp*31+part+i)%611/cast(7.0 as double) as double) abs_delta,
  cast((part*37+i)%89/cast(100.0 as double) as double) alpha_seg_cv, cast((part*41+supp*i)%257/cast(100.0 as double) as double) start_rms_ratio, cast((supp*43+part*i)%401/cast(110.0 as double) as double) start_slope_ratio,
  cast((part*47+supp+i)%347/cast(500.0 as double) as double) h1_alpha, cast((supp*53+part*i)%149/cast(900.0 as double) as double) h2x
  from ({WAVES}) w cross join (select 0 i union all select 1 union all select 2 union all select 3) n) m"""

#: Texts found on pages besides the known ones; none on some pages.
TEXTS = """
select cast(l_orderkey as string) rec, l_linenumber page_no, case when l_partkey%4=0 then null else
  case l_partkey%6 when 0 then '滤波 70Hz' when 1 then '陷波' when 2 then '采样率' when 3 then 'abc' when 4 then '50 Hz' else '滤波器' end end text
from {lineitem}"""

TABLES = re.compile(r"\{(region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings)\}")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The fixture as a DataFrame over the tables of ``sf_dir``."""
    names = set(TABLES.findall(sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def plain(sql: str) -> str:
    """The fixture as SQL over table names."""
    return TABLES.sub(r"\1", sql)
