"""Labels and sentences that appear in result tables."""

PRE, POST = "政策前", "政策后"

# Right-closed cuts (a, b]: edges and one label per interval.
DISTANCE_CUTS = ((0, 2, 8, None), ("short", "medium", "long"))
DISTANCE_SEGMENT_CUTS = ((0, 2, 8, None), ("短途", "中途", "长途"))
DISTANCE_GROUP_CUTS = ((0, 2, 8, None), ("短途(0-2英里)", "中途(2-8英里)", "长途(8+英里)"))
REPORT_WINDOW_CUTS = ((-1, 5, 10, 14, 20, 24), ("凌晨", "早高峰", "午间", "晚高峰", "夜间"))
SEGMENT_HOUR_CUTS = (
    (-1, 6, 10, 16, 20, 24), ("night", "morning_peak", "noon", "evening_peak", "late_evening"),
)
MART_HOUR_CUTS = ((-1, 5, 9, 16, 20, 23), ("夜间", "早高峰", "日间", "晚高峰", "深夜"))
DASHBOARD_WINDOW_CUTS = (
    (-1, 5, 9, 13, 16, 20, 23),
    ("凌晨 0-5", "早高峰 6-9", "上午 10-13", "下午 14-16", "晚高峰 17-20", "夜间 21-23"),
)

ZONE_GROUP_LABELS = {
    "treated_zones": "收费核心区", "spillover_zones": "需求外溢区",
    "control_zones": "对照区", "other": "其他区域",
}
ZONE_GROUP_CHART_LABELS = {
    "control_zones": "对照区", "other": "其他区域",
    "spillover_zones": "外溢区", "treated_zones": "收费核心区",
}
WEEKDAY_LABELS = ("周一", "周二", "周三", "周四", "周五", "周六", "周日")
METRIC_LABELS = {
    "log_order_count": "订单量对数", "avg_fare_per_mile": "每英里平均票价",
    "avg_driver_pay_per_minute": "每分钟司机收入", "airport_trip_count": "机场订单量",
    "short_trip_count": "短途订单量",
}
EVIDENCE_LABELS = {
    "spillover_score": "外溢评分",
    "demand_gap_rate": "需求缺口率",
    "post_policy_average_orders": "政策后平均订单",
    "post_policy_order_count": "政策后订单量",
    "tolls_change_rate": "通行费变化率",
    "driver_pay_per_minute_change_rate": "每分钟司机收入变化率",
    "fare_per_mile_change_rate": "每英里票价变化率",
    "response_time_p90_change_min": "P90 响应时长变化（分钟）",
    "slow_response_rate_change": "慢响应占比变化",
}
NO_EVIDENCE = "暂无可用证据指标"
NO_HOUR = "按小时监控"

INTERPRET_SPILLOVER_SHIFT = "用于识别可能承接核心区转移需求的区域组。"
INTERPRET_OTHER_SHIFT = "用于比较政策前后不同区域组的订单变化。"
INTERPRET_OD = "OD 路线用于判断需求变化是乘客侧价格问题还是司机收益压力问题。"
INTERPRET_PRICE = "单位里程价格上升且订单下降的分组，是乘客优惠的候选对象。"
INTERPRET_DRIVER = "通行费压力上升且司机单位时间收益承压的高订单路线，优先进入司机激励试点。"
INTERPRET_AIRPORT = "机场路线客单价高，应同时观察需求、司机收益和响应效率。"
INTERPRET_RESPONSE = "外溢区订单承接且 P90 响应时长变慢，说明司机供给可能未同步迁移。"
AREA_CORE, AREA_OTHER = "收费核心区相关", "其他区域"
AIRPORT_ACT, AIRPORT_WATCH = "优先派单或司机激励试点", "持续监控"
DID_DEMAND = (
    "Policy-period treated-zone change relative to control zones; negative demand "
    "coefficients indicate a relative demand contraction."
)
DID_OTHER = (
    "Policy-period treated-zone price or driver-side metric change relative to control zones."
)
DID_NO_VARIATION = "treated x post does not vary within zones"
DID_COLLINEAR = "treated x post is a combination of the other design columns"
DROP_REASON = "invalid time, location, distance, duration or fare values"

SUPPLY_ACTION = "在目标时段前预部署司机，并按实时请求量动态调整区域推荐权重。"
SUPPLY_IMPACT = "缩短边界区接驾时间，减少核心区无效等待。"
INCENTIVE_ACTION = "对该路线试行司机侧定向激励，并以接单率和取消率作为扩量门槛。"
INCENTIVE_IMPACT = "稳定高价值路线供给，降低司机因通行成本和时间成本带来的拒单风险。"
DISCOUNT_ACTION = "在目标区域和时段测试乘客侧价格减免，并设置预算上限与对照组。"
DISCOUNT_IMPACT = "验证价格干预能否恢复需求，而不在司机收益已受压的路线重复补贴。"
AIRPORT_CARD_ACTION = "为机场至核心区路线设置优先派单和司机激励试点。"
AIRPORT_CARD_IMPACT = "降低机场高价值路线的供给波动并稳定服务可得性。"
BOUNDARY_ACTION = "将边界区加入高峰调度热区，并按小时复核供给响应。"
BOUNDARY_IMPACT = "在需求转移发生时提升匹配效率，避免核心区运力惯性滞留。"
LOW_VALUE_ACTION = "下调该区域的司机推荐权重，避免在低价值时段扩大无效等待。"
LOW_VALUE_IMPACT = "减少低收益供给占用，把运力释放给需求更强的区域或路线。"
PROBLEM_SUPPLY = "边界区域的外溢评分和政策后需求表明，该区域可能承接了核心区转移需求；响应时长代理用于判断供给是否跟上。"
PROBLEM_ROUTE = "该高价值路线的通行成本压力高于司机单位时间收入变化，需要先验证供给侧激励。"
PROBLEM_AIRPORT = "机场路线仍有订单量，但通行成本与司机单位时间收益的组合需要专项运营，而非通用优惠。"
PROBLEM_DISCOUNT = "该区域实际需求低于无政策基线，同时乘客单位里程价格上升。"
PROBLEM_BOUNDARY = "收费区边界附近出现可能的需求承接，应将其作为新的调度节点而不是沿用旧热区。"
PROBLEM_LOW_VALUE = "该非机场区域的司机单位时间收益走弱，且没有明显外溢承接信号。"
WINDOW_ROUTE, WINDOW_AIRPORT = "晚高峰优先", "航班到达高峰"

# Policy cards (English set).
BOUNDARY_PROBLEM_EN = (
    "Boundary-zone demand may be absorbing trips displaced from the congestion zone."
)
BOUNDARY_ACTION_EN = "Pre-position drivers and cap idle time through zone-level dispatch nudges."
BOUNDARY_IMPACT_EN = "Improve pickup reliability while avoiding excess waiting in the core."
ROUTE_PROBLEM_EN = "Passenger price increased while driver pay per minute did not keep pace."
ROUTE_ACTION_EN = (
    "Test targeted driver incentive with holdout measurement before broad subsidy rollout."
)
ROUTE_IMPACT_EN = "Protect route supply on economically unattractive trips."
HOUR_PROBLEM_EN = "This operating window had the largest observed demand contraction."
HOUR_ACTION_EN = (
    "Reduce blanket driver positioning and use demand-triggered dispatch thresholds."
)
HOUR_IMPACT_EN = (
    "Lower unproductive driver time while preserving service where requests remain."
)

# Business recommendations: action, value, confidence.
REC_SUPPLY = ("在高需求时段前预部署司机并监控响应代理", "降低可能的供给滞后", "低")
REC_ROUTE = ("将高频路线纳入重点保障与运力观察", "保障核心出行场景", "中")
REC_DRIVER = ("先以小范围激励测试接单与履约变化", "缓解高频低收益路线供给压力", "低")
REC_DISCOUNT = ("在验证需求弹性后测试定向优惠", "降低高价格路线的需求流失风险", "低")
