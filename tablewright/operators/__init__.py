"""DataFrame -> DataFrame operators (statistics, audit, EDA, planning, evaluation)."""
