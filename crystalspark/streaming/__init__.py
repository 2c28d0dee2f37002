"""crystalspark.streaming"""
