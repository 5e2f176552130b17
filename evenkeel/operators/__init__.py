"""evenkeel.operators"""
