def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
