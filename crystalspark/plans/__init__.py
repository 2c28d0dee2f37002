"""crystalspark.plans"""
