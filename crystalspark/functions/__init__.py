"""crystalspark.functions"""
