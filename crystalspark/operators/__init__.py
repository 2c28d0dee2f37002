"""crystalspark.operators"""
